"""The sample of language ID: every language, and usable rows only."""

import random

from glyphmill.llm import langid
from pyspark.sql import functions as F


def test_every_language_is_learned(spark, make, monkeypatch):
    """More languages than full samples, and one whose sample would be null texts and a repeated id."""
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    monkeypatch.setattr(langid, "PER_LANGUAGE", 3)
    rng = random.Random(5)
    alphabets = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop"}
    rows = [(lang, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(20))) for lang, a in alphabets.items() for _ in range({"dd": 2}.get(lang, 12))]
    rows += [("cc", None)] * 60 + [("cc", "12")] * 60
    docs = make([t for _, t in rows], langs=[lang for lang, _ in rows])
    docs = docs.union(docs.filter("doc_id = 25")).union(docs.filter("doc_id = 25"))
    assert langid.train(docs, F.lit(True)).languages == ("aa", "bb", "cc", "dd")
