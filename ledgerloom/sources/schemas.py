"""Schemas and fixed vocabularies of the contract graph."""

from __future__ import annotations

PROPS = "map<string,string>"
NODE = f"struct<name:string,type:string,properties:{PROPS}>"
EDGE = f"struct<source:string,relation:string,target:string,properties:{PROPS}>"
PAGES_EXTRACTED = f"doc string, page int, raw_text string, status string, error string, nodes array<{NODE}>, edges array<{EDGE}>, suggested_new_types array<struct<type:string,reason:string>>"
PAGE_INSIGHTS = (
    "_source_file string, error string, document_type_guess string, section_heading string, parties array<struct<name:string,role:string>>,"
    " dates_or_milestones array<struct<label:string,value:string>>, monetary_values array<struct<label:string,amount:string>>,"
    " cross_document_references array<struct<reference_text:string,target_document_number:string>>,"
    " tables_detected array<struct<title:string,columns:array<string>>>, confidentiality_marking string, has_signature boolean, notes string"
)
CHUNKS = (
    "chunk_id string, contract_id string, revision int, document_type string, section_path string, page int, content_type string,"
    " text string, chunk_hash string, embedding array<float>, embedding_dims int, superseded boolean, ingested_at timestamp"
)
GRAPH_NODES = f"label string, canonical_name string, props {PROPS}, element_id string"
GRAPH_EDGES = f"src_label string, src_name string, rel_type string, tgt_label string, tgt_name string, props {PROPS}, confidence double"

# The node and edge types that extraction starts from.
NODE_TYPES = [
    "Contract", "ContractRecord", "Party", "Person", "Role", "Section", "Requirement", "Standard", "Deliverable", "Site",
    "BusinessCategory", "Initiative", "Milestone", "PricingTrack", "LaborCategory", "Goal", "OrgUnit",
]
EDGE_TYPES = [
    "HAS_SECTION", "CONTAINS_REQUIREMENT", "REFERENCES_STANDARD", "HAS_DELIVERABLE", "DUE_TO", "SIGNED_BY", "HAS_ROLE",
    "COVERS_SITE", "HAS_GOAL", "RUNS_INITIATIVE", "HAS_MILESTONE", "SUPPORTS_CATEGORY", "PRICED_UNDER", "USES_LABOR_CATEGORY",
    "MANAGED_BY", "PARTY_TO", "PARENT_OF", "SUPERSEDES", "SAME_AS", "RELATED_TO",
]
# Columns of the metadata table by group.
METADATA_FIELDS = {
    "identifiers": ["ID", "General Contract ID", "Sales Contract ID", "Legacy Contract ID", "Legacy Unique Identifier", "Previous Document ID", "General Contract Number", "Sales Contract Number", "Legacy Contract Number", "Legacy Contract Customer Contract Number", "SFDC Opportunity Number"],
    "lineage_relationships": ["Related To", "Sales Contract Parent Agreement ID", "Sales Contract Parent Contract Number"],
    "classification": ["Document Type", "Status", "Sales Contract Status", "Sales Contract Type", "Sales Contract Subtype", "General Contract Confidential", "Sales Contract is Confidential"],
    "org_hierarchy": ["General Contract Managing Unit", "Sales Contract Managing Unit", "General Contract SBEs", "General Contract SBGs", "General Contract SBUs", "Sales Contract SBEs", "Sales Contract SBUs", "Sales Contract SBGs", "Legacy Contract SBGs"],
    "dates": ["Date Created", "Date Updated", "General Contract Expiration Date", "Legacy Contract Effective Date", "Legacy Contract Expiration Date", "Sales Contract Effective Date", "Sales Contract Expiration Date", "Sales Contract Date Created"],
    "financial": ["Sales Contract or Amendment Value", "Sales Contract or Amendment Value USD", "Sales Contract Currency Code"],
    "party": ["General Contract Party Name", "Sales Contract Company Name", "Sales Contract Region", "Sales Contract Business Model"],
    "bookkeeping": ["Attached File", "Document Source", "File is Already OCRd", "ID Text", "Bot Status", "RPA TimeStamp", "LeapFileName", "Annotation_Tool_Status"],
}
# Metadata fields that take precedence over extracted properties.
OVERLAY_FIELDS = ["Sales Contract Effective Date", "Sales Contract Expiration Date", "Sales Contract or Amendment Value USD", "Sales Contract Status", "Sales Contract Type", "General Contract Managing Unit", "Sales Contract Company Name", "Document Type"]
# Document types of photographed pages.
DOCUMENT_TYPES = [
    "sales_agreement", "statement_of_work", "government_solicitation_form", "wage_determination_table", "subcontracting_plan",
    "milestone_schedule", "payment_or_pricing_table", "termination_liability_schedule", "signature_page", "terms_and_conditions",
    "applicable_documents_table", "wbs_or_org_diagram", "other",
]
# Words of company names that carry no identity.
LEGAL_WORDS = ["inc", "incorporated", "llc", "l.l.c", "corp", "corporation", "co", "company", "ltd", "limited", "international", "aerospace", "space", "group", "holdings"]

CONFIDENCE_THRESHOLD, DEFAULT_CONFIDENCE = 0.75, 0.85
DUPLICATE_THRESHOLD, MERGE_THRESHOLD, CONTAINMENT = 0.78, 0.85, 0.9
HUBS, EXAMPLES, INSTANCE_NODES, PAYLOAD_CHARS, IMAGE_SIDE = 30, 10, 120, 60_000, 1600
EMPTY_PAGE = {"nodes": [], "edges": [], "suggested_new_types": []}
