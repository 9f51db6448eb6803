"""Reading and writing: exports of differing schemas, texts, shards, caches; tables, audits, reports."""
