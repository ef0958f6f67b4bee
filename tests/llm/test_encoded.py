"""The last stage of the pipeline gives the encoded corpus itself."""

from __future__ import annotations

import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from studyloom.llm import _shared
from studyloom.llm.queries import tokenizer_path


def test_ids_and_texts_of_every_document(spark, odd, monkeypatch):
    monkeypatch.setattr(_shared, "PIECE_CHARS", 30)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    more = spark.createDataFrame([(90, "word tree " * 9_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.select(corpus_pipeline.COLUMNS).unionByName(more)
    rows = corpus_pipeline.encoded(spark, docs, "").collect()
    assert sorted(repr((r.doc_id, r.text)) for r in rows) == sorted(repr((r.doc_id, r.text)) for r in docs.collect())
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(r.token_ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
