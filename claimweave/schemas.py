"""Schemas of the engine's relations, as Spark DDL."""

COMPANIES = "ticker string, name string, cik long"
TOPICS = "id string, name string, description string, aliases array<string>"
DOCUMENTS = "document_id string, doc_type string, date string, period string, source_url string, source_type string, raw_ref string, ticker string"
SECTIONS = "document_id string, section_id string, ordinal int, heading string"
CHUNKS = "chunk_id string, document_id string, section_id string, paragraph_index int, text string, chunk_type string, is_heading boolean, char_len int, speaker string, speaker_role string, page int, bbox array<double>"
CLAIMS = "claim_id string, document_id string, chunk_id string, section_id string, paragraph_index int, topic string, speaker string, role string, claim_text string, quote_span string, stance string, value_numeric double, date string, source_type string, doc_type string, company_ticker string, page int, bbox array<double>, extracted_by string, extracted_at string"
SPEAKERS = "speaker_id string, name string, role string, company_ticker string"
MADE = "speaker_id string, claim_id string"
APPEARS_IN = "claim_id string, document_id string"
ABOUT = "claim_id string, topic_id string"
FILED_BY = "document_id string, ticker string"
CONTRADICTIONS = "a_id string, b_id string, severity string, reasoning string, judged_at string, judged_by string"
CLAIM_VECTORS = "point_id string, claim_id string, topic string, speaker string, source_type string, date string, document_id string, ticker string, stance string, quote_span string, claim_text string, vector array<float>"
JOB_EVENTS = "job_id string, seq long, ticker string, status string, stage string, progress int, message string, error string"

#: A parsed document as stored in JSON: sections with their chunks inside.
DOCUMENT_JSON = (
    "document_id string, doc_type string, date string, period_of_report string, source_url string, source_type string, raw_ref string, "
    "company struct<ticker:string,cik:bigint,name:string>, parsed_at string, "
    "sections array<struct<section_id:string,ordinal:int,heading:string,chunks:array<struct<chunk_id:string,document_id:string,section_id:string,"
    "paragraph_index:int,text:string,chunk_type:string,is_heading:boolean,char_len:int,speaker:string,speaker_role:string,page:int,bbox:array<double>>>>>"
)
#: A model's answer about a pair of claims, and about a chunk.
JUDGMENT = "contradicts string, is_contradiction string, contradiction string, severity string, reasoning string, explanation string"
RAW_CLAIM = "topic string, speaker string, role string, claim_text string, quote_span string, stance string, value_numeric double"

#: Primary keys, which the writers keep by construction and the tests assert.
KEYS = {"companies": ["ticker"], "topics": ["id"], "documents": ["document_id"], "claims": ["claim_id"], "speakers": ["speaker_id"], "made": ["speaker_id", "claim_id"], "appears_in": ["claim_id", "document_id"], "about": ["claim_id", "topic_id"], "filed_by": ["document_id", "ticker"], "contradictions": ["a_id", "b_id"], "claim_vectors": ["point_id"]}
