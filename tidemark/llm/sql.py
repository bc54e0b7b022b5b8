"""Independent SQL of the document queries, where there is any."""

ORACLES = {
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
