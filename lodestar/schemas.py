"""Table layouts, as DDL."""

SHARDS = "document_id string, shard_index int, shard_id string, start int, end int, text string"
EXTRACTION = "extraction_class string, quote string, offset_mode string, char_start int, char_end int, grounding string, attributes_json string"
STAGE = "pass int, stage string, status string, failure_kind string, message string"
REPAIR = "found boolean, start int, end int, kind string, source_length int, candidate_length int, applied array<string>, changed boolean, candidate_truncated boolean, repair_truncated boolean"
RECORD = "provider string, model string, request_hash string, channel string"
OUTCOME = (
    "run_id string, document_id string, shard_id string, shard_index int, start int, end int, status string, from_checkpoint boolean, attempts int, prompt_hash string, "
    f"failure_kind string, failure_message string, error_name string, retryable boolean, final_pass int, max_passes int, "
    f"extractions array<struct<{EXTRACTION.replace(' ', ':').replace(',:', ',')}>>, "
    f"stages array<struct<{STAGE.replace(' ', ':').replace(',:', ',')}>>, repair struct<{REPAIR.replace(' ', ':').replace(',:', ',')}>, record struct<{RECORD.replace(' ', ':').replace(',:', ',')}>"
)
#: One case of the two evaluation datasets.
SMOKE = "caseId string, documentText string, instructions string, targetSchema string, providerResponseText string, goldSpans array<struct<extractionClass:string,quote:string,charStart:int,charEnd:int>>"
REGRESSION = (
    "caseId string, category string, documentText string, instructions string, targetSchema string, providerResponseText string, "
    "expected struct<emptyResultKind:string,minExtractions:int,maxExtractions:int>, sourceUrl string, sourceQuote string, packId string"
)
EXTRACTION_DOC = "extractionClass:string,quote:string,offsetMode:string,charStart:int,charEnd:int,span:struct<offsetMode:string,charStart:int,charEnd:int>,attributes:string,grounding:string"
BUNDLE = f"bundleVersion string, runId string, extractions array<struct<{EXTRACTION_DOC}>>, provenance struct<documentId:string,textHash:string,createdAt:string,programHash:string>, shardPlan struct<chunkSize:int,overlap:int,shardCount:int>"
