"""Language identification with language-bitmask n-gram filters.

The model is a bit-sliced Bloom filter: slot i holds one bit per language, and
the conjunction of an n-gram's slots is the set of all languages whose filter
contains it. A document's n-grams are counted per language, the count expected
from false positives is taken off, and the language with the largest rest wins.

A language's filter holds the letter n-grams (3 and 4 letters, with word ends)
that make up at least `min_rate` of its n-grams and at least `min_share` of the
rate they have in the language where they are most usual.

Fitting reads a bounded sample: about `sample_docs` documents of each language,
chosen by a hash of the id, whole texts. What reaches the driver is at most
1 / min_rate n-grams for each n and language. Texts of any length are read in pieces of
bounded size. Prediction covers every document,
row by row, without a shuffle.

Defined results: `und` with score 0 for a null text or one without a letter;
where no n-gram is known the language with the most training documents, score 0;
ties go to the language first in code point order. Without training rows every
prediction is `und`. Repeated rows get equal results, an empty table none; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.llm.common import cut, sliced

ORDERS = (3, 4)
HASHES = 3
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _letters[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of the n-grams of all texts, and the number of the text that each lies in.

    Words are runs of letters, in lower case, between word ends (code 0). An
    n-gram may begin or end, but not go on, at a word end.
    """
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) + 2 for c in codes])
    edge = np.zeros(1, np.uint32)
    flat = np.concatenate([x for c in codes for x in (edge, c, edge)]) if codes else edge
    flat = np.where(letters()[flat], flat, 0).astype(np.uint64)
    keep = flat > 0
    keep[1:] |= flat[:-1] > 0  # the first code behind a word ends it
    keep[np.flatnonzero(np.diff(owner, prepend=-1))] = True  # and each text begins with an end
    flat, owner = flat[keep], owner[keep]
    for n in ORDERS:
        if len(flat) < n:
            continue
        size = len(flat) - n + 1
        inside = np.ones(size, bool)
        code = np.full(size, n, np.uint64)
        for k in range(n):
            part = flat[k : k + size]
            if 0 < k < n - 1:
                inside &= part > 0
            code = (code + part) * _MIX[0]
            code ^= code >> np.uint64(29)
        at = np.flatnonzero(inside)
        code = code[at] * _MIX[1]
        code ^= code >> np.uint64(32)
        code *= _MIX[2]
        code ^= code >> np.uint64(31)
        yield code, owner[at + 1]


#: Where a text may be cut: no n-gram goes on over what is no letter.
_GAP = re.compile(r"[\W\d_]")


def chunks(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers of texts and pieces of them, about `most` characters together; long texts are cut behind a gap, which changes no n-gram."""
    owners, pieces, held = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + most - held
            if end < len(text):
                gap = _GAP.search(text, end)
                end = gap.end() if gap else len(text)
            owners.append(k)
            pieces.append(text[at:end])
            held += len(pieces[-1])
            at = end
            if held >= most:
                yield np.array(owners), pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield np.array(owners), pieces


@dataclass
class Filter:
    """The bit-sliced filter: `slots` has one mask per slot, as many 64 bit words wide as the languages need."""

    langs: list[str]
    default: str
    slots: np.ndarray

    @classmethod
    def build(cls, langs: list[str], default: str, codes: np.ndarray, owners: np.ndarray) -> Filter:
        size = 1 << max(12, int(len(codes) * 8 - 1).bit_length() if len(codes) else 12)
        slots = np.zeros((size, -(-max(1, len(langs)) // 64)), np.uint64)
        for at in cls.places(codes.astype(np.uint64), size):
            np.bitwise_or.at(slots, (at, owners // 64), np.uint64(1) << (owners % 64).astype(np.uint64))
        return cls(langs, default, slots)

    @staticmethod
    def places(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        step = (codes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((codes + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)

    def false_rate(self) -> np.ndarray:
        fill = [np.count_nonzero(self.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / len(self.slots) for i in range(len(self.langs))]
        return np.array(fill) ** HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        docs = [t or "" for t in texts]
        hits, total = np.zeros((len(docs), len(self.langs))), np.zeros(len(docs))
        for code, owner in ((code, owners[owner]) for owners, pieces in chunks(docs) for code, owner in grams(pieces)):
            masks = None
            for at in self.places(code, len(self.slots)):
                got = self.slots[at]
                masks = got if masks is None else masks & got
            total += np.bincount(owner, minlength=len(docs))
            for i in range(len(self.langs)):
                has = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[:, i] += np.bincount(owner, weights=has, minlength=len(docs))
        rate = self.false_rate()
        real = np.maximum(0, (hits - total[:, None] * rate) / np.maximum(1e-9, 1 - rate))
        names, scores = [], []
        for row, n in zip(real, total, strict=True):
            whole = float(row.sum())
            if not n or not self.langs:
                names.append("und")
                scores.append(0.0)
            else:
                best = int(row.argmax())
                names.append(self.langs[best] if whole else self.default)
                scores.append(float(row[best]) / whole if whole else 0.0)
        return names, scores


def held_out(id_col: str = "doc_id", fold: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no rest; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % fold == 0


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 3000, min_rate: float = 2e-5, min_share: float = 0.3) -> Filter:
    """Learn a Filter from rows with a language."""
    rows = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.where("t IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Filter.build([], "und", np.zeros(0, np.uint64), np.zeros(0, np.int64))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / counts[k]))])
    place = F.pmod(F.xxhash64(F.lit(17), F.col("i")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(F.col("t").isNotNull() & (place < F.element_at(share, F.col("lang")))).select("t", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t", 4 << 20):
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("t").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, pieces in chunks(texts):
                    for n, (code, _) in zip(ORDERS, grams(pieces), strict=False):
                        got, many = np.unique(code, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got)), pa.array(np.full(len(got), n, np.int32)), pa.array(got.view(np.int64)), pa.array(many)], ["lang", "n", "code", "seen"])

    seen = sample.mapInArrow(count, "lang string, n int, code long, seen long").groupBy("lang", "n", "code").agg(F.sum("seen").alias("seen"))
    seen = cut(seen)
    sums = {(r["lang"], r["n"]): r["s"] for r in seen.groupBy("lang", "n").agg(F.sum("seen").alias("s")).collect()}
    if not sums:
        return Filter.build(langs, max(langs, key=counts.get), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    whole = F.create_map(*[F.lit(x) for (k, n), s in sorted(sums.items()) for x in (f"{n}{k}", float(s))])
    rates = seen.withColumn("rate", F.col("seen") / F.element_at(whole, F.concat(F.col("n").cast("string"), F.col("lang")))).where(F.col("rate") >= min_rate)
    tops = rates.groupBy("code").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("each"))  # a code has one row a language at most
    chosen = tops.select("code", F.explode(F.filter("each", lambda x: x["rate"] >= min_share * F.col("top"))["lang"]).alias("lang")).collect()
    number = {k: i for i, k in enumerate(langs)}
    chosen.sort(key=lambda r: (r["code"], r["lang"]))
    return Filter.build(langs, max(langs, key=counts.get), np.array([r["code"] for r in chosen], np.int64).view(np.uint64), np.array([number[r["lang"]] for r in chosen], np.int64))


def identify(df: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """All columns of df, and lang_pred and score (in place of columns of these names)."""
    keep = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by what fit() keeps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col, 1 << 20):
            names, scores = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*keep).mapInArrow(run, schema)
