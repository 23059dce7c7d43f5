"""The pipeline against plain Python: which documents stay, how often, and their token ids."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from test_operators import components_by_hand

import corpus_pipeline
from tesseral.llm import langid
from tesseral.llm.queries import piece_file, tokenizer_file
from tesseral.llm.sql import OP1

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def language(text: str | None, model: langid.Model, kept: dict) -> float:
    """The posterior of the likeliest language, by plain sums over the segmentations of each word; 0 without a letter."""
    if not text or not any(c.isalpha() for c in text):
        return 0.0
    pieces = {p: i for i, p in enumerate(model.pieces)} if not kept else kept["pieces"]
    kept.setdefault("pieces", pieces)
    total = np.zeros(len(model.languages))
    for word in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text.lower()):
        if word not in kept:
            data = b" " + word.encode()
            sums = [np.ones(len(model.languages))]
            for end in range(1, len(data) + 1):
                sums.append(sum(sums[end - n] * model.chance[pieces[data[end - n : end]]] for n in range(1, min(end, 40) + 1) if data[end - n : end] in pieces))
            kept[word] = np.log(sums[-1])
        total += kept[word]
    return float(1 / np.exp(total - total.max()).sum())


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(text: str | None) -> set:
    w = words(text)
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def test_pipeline(spark, duck, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    model, kept = langid.train(docs, piece_file()), {}
    rows = [r for r in rows if language(r["text"], model, kept) >= corpus_pipeline.LANGUAGE_SCORE]
    component = components_by_hand([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    bench = set().union(*[grams(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    short = {len(g) for g in bench}
    rows = [r for r in rows if not any(tuple(w[i : i + n]) in bench for w in [words(r["text"])] for n in short for i in range(len(w) - n + 1))]
    duck.register("stayed", pa.Table.from_pylist([r.asDict() for r in rows]))
    taken = {r[0]: r[1] for r in duck.sql(f"SELECT doc_id, CAST(taken / greatest(size, 1) AS INTEGER) FROM ({OP1.replace('FROM documents', 'FROM stayed')})").fetchall()}
    tokenizer = Tokenizer.from_file(tokenizer_file())
    crc = lambda text: zlib.crc32(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    want = Counter({(r["doc_id"], crc(r["text"])): taken[r["doc_id"]] for r in rows if taken[r["doc_id"]]})
    got = Counter((r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and 0 < len(got) < docs.count()


def test_odd_rows(spark, sf_dir, tmp_path):
    """Nulls in any column, empty and repeated rows, clashing column names, and an empty table."""
    good = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "12 34", None, "s", 1), (None, "The text of a document without an id and a language", None, None, None), (3, None, "xx", "s", None)]
    docs = good.unionByName(spark.createDataFrame(odd, good.schema)).unionByName(good.limit(3))
    for extra in ("spans", "items", "taken", "lang_pred", "_w", "component_id"):
        docs = docs.selectExpr("*", f"source as {extra}")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs.write.parquet(str(tmp_path / name))
        docs = stage(spark, spark.read.parquet(str(tmp_path / name)), sf_dir)
        assert docs.columns == columns or name == "token_ids"
    assert docs.count() > 20
    none = good.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
