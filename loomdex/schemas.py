"""Schemas of the store's tables, as DDL; the store reads and writes by them."""

VIDEOS = "video_id string, title string, blog_url string, url string, published_date date, tags array<string>, video_length_chars int, batch int"
CHUNKS = "ordinal long, chunk_id string, video_id string, chunk_idx int, text string, embed_text string, summary string, start_char int, end_char int"
EMBEDDINGS = "run_id string, chunk_id string, embedding array<float>"
RUNS = "run_id string, model_name string, dimension int, created_at timestamp, path string, is_active boolean, notes string"
