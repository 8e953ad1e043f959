"""Places of very many matches in one text."""

import time

from pyspark.sql import functions as F

from labelloom.llm import pii


def test_a_text_of_many_numbers(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, " ".join(f"n{i % 977}" for i in range(n))), (2, "a@b.co " * 3000)], "doc_id long, text string")
    began = time.time()
    spans = docs.select("doc_id", pii.located(F.col("text"), pii.TOKEN).alias("spans"))
    told = spans.select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1).alias("last"), F.get("spans", F.lit(1000)).alias("one")).collect()
    rows = {r.doc_id: r for r in told}
    text = docs.where("doc_id = 1").first().text
    assert rows[1].n == n and rows[1].last.stop == len(text) and rows[1].one.start == len(" ".join(f"n{i % 977}" for i in range(1000))) + 1
    assert (rows[1].one.before, rows[1].last.after) == (" ", "")
    assert rows[2].n == 3000 and rows[2].one.start == 7000
    assert time.time() - began < 60


def test_a_text_of_many_seeds_is_labelled_and_redacted(spark):
    n = 10_000
    text = " ".join(f"mail a{i}@b.co to{i} 10.0.{i % 256}.1" for i in range(n))
    docs = spark.createDataFrame([(1, "s", "en", text, len(text)), (2, "s", "en", None, None)], "doc_id long, source string, lang string, text string, n_chars long")
    began = time.time()
    clean = pii.redact(docs).orderBy("doc_id").collect()
    assert clean[0].text == " ".join(f"mail [EMAIL] to{i} [IP]" for i in range(n)) and clean[1].text is None
    marks = {r.doc_id: r for r in pii.marked(docs).collect()}
    kinds = [t.kind for t in marks[1].tokens]
    assert len(marks[1].base) == 2 * n and len(kinds) == 3 * n and kinds[:3] == [0, None, 1] and kinds[-3:] == [0, None, 1]
    assert marks[1].tokens[3].value == "a1@b.co" and (marks[2].base, marks[2].tokens) == ([], [])
    assert time.time() - began < 120


def test_words_of_any_length_are_contexts(spark):
    long = "w" * 100
    docs = spark.createDataFrame([(1, f"x {long} {'v' * 60}   7 {long}q,")], "doc_id long, text string")
    token = docs.select(F.explode(pii.located(F.col("text"), pii.TOKEN)).alias("t")).select("t.*").first()
    assert (token.before, token.after) == (f"{long} {'v' * 60}   ", f"{long}q,")
    found = {r.pattern for r in pii.occurrences(pii.marked(docs)).collect()}
    assert found == {f"{long} {'v' * 60} _", f"{'v' * 60} _ {long}q,"}


def test_redaction_of_overlapping_spans_in_many_runs(spark):
    """Runs end inside a span that reaches over several others."""
    parts = ["+1 (202) 555.0100.11", "10.0.0.1", "+1 10.20.30.40 22", "4111 1111 1111 1111", "é a@b.co"]
    texts = [" ".join(parts[(i * k) % len(parts)] for i in range(m)) for k, m in ((1, 1), (1, 7), (2, 50), (3, 101))]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    spans = {r.doc_id: sorted((s.start, s.stop, s.kind) for s in r.spans) for r in pii.find(docs).collect()}
    for row in pii.redact(docs).collect():
        text, at, out = texts[row.doc_id], 0, ""
        for start, stop, kind in spans[row.doc_id]:
            if start >= at:
                out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, stop)
        assert row.text == out + text[at:]
