"""Schemas of the relations that operators exchange."""

CELLS = "doc string, sheet string, row int, col int, display string, raw string, formula string, data_type string, bold boolean, merged_master string, row_span int, col_span int, style string"
MERGES = "doc string, sheet string, r0 int, c0 int, r1 int, c1 int"
ASSETS = "doc string, sheet string, asset_id string, asset_type string, uri string, anchor string, description string, ord int, content binary"
TEXTS = "doc string, sheet string, ord int, text string"
DIAGNOSTICS = "doc string, code string, severity string, message string, sheet string, cell string"
SEGMENTS = "session long, seq long, id string, text string, translation string, status string, start_ms long, end_ms long"
SESSIONS = "session long, state string, started_ms long, language string"
JOBS = "job string, session long, segment string, state string, attempts int, next_at long, error string"
MANIFEST = "manifest_version string, assets array<struct<asset_id:string,path:string,sheet:string,region_id:string,asset_type:string,description:string,anchor:string>>"
MESSAGE = "v int, type string, sessionId string, seq long, text string, pcm string, frames int, language string"
