"""Problem 4: natural language inside code, its language and its share of each file.

Comments and strings are lexed from files; markers and symbols point to theirs
by line; code-like parts are removed; character n-gram naive Bayes identifies
the language; the bytes that prose takes in the source are totalled per file and
language. Where the newest version of a file doesn't hold what a marker or symbol
says, or the file is missing, what the row itself says is taken.

The classifier is fitted on a bounded sample of labelled documents
(``PER_LANGUAGE`` of each language); everything else covers all rows. Null and
empty texts, and texts without enough words, have no language and are no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.codelex import Source, family, tokens
from codestrata.llm.functions import attached, clean_comment, description
from codestrata.llm.located import beside_files
from codestrata.shared import latest

#: The languages that are told apart; the first is the default.
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "vi", "ru", "zh", "ja")
#: Labelled documents of each language that the classifier is fitted on, at most, and the bytes of one at most.
PER_LANGUAGE, SAMPLE_BYTES = 200, 32_768
#: Hash buckets of the n-grams, lengths of the n-grams, words (or CJK letters) that prose has at least.
BUCKETS, NGRAMS, MIN_WORDS, MIN_CJK = 1 << 16, (1, 2, 3, 4), 4, 6
#: How much likelier, in nats, another language must be than English.
MARGIN = 3.0

_CODE = re.compile(
    r"```.*?```|`[^`\n]*`|https?://\S+|\w+://\S+|<[^<>\n]{1,80}>|\{@?[^{}\n]*\}|\S*[\w)]\([^()\n]*\)[;{]?|\b\w*_\w*\b|\b[a-z]+[A-Z]\w*\b|\b\w+(?:\.\w+)+\b|[\w.\-]*/[\w./\-]+"
    r"|\b\w*\d\w*\b|\S*(?:=>|->|::|==|!=|&&|\|\||\+=)\S*|@\w+",
    re.S,
)
_REFERENCE = re.compile(r"\((?:see|ref|cf)\.?\s*[^()]*\)", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def bare_prose(text: str) -> str:
    """``text`` without code-like parts, references and marks; single spaces."""
    text = _CODE.sub(" ", _REFERENCE.sub(" ", unicodedata.normalize("NFC", text)))
    return " ".join(re.sub(r"[^\w\s'’]|[\d_]", " ", text).split()).lower()


def enough(prose: str) -> bool:
    return len(_WORD.findall(prose)) >= MIN_WORDS or len(_CJK.findall(prose)) >= MIN_CJK


def plain(text: str) -> str:
    """``text`` without accents, as people without the right keyboard write it."""
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("ß", "ss")) if not unicodedata.combining(c))


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, index of its text) of all texts at once."""
    codes = [np.frombuffer(f" {t} ".encode("utf-32-le"), dtype=np.uint32) for t in texts]
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    buckets, owners = [], []
    for n in NGRAMS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ flat[i : len(flat) - n + 1 + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(23)
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((h[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(h)][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.empty(0, np.int64), np.empty(0, np.int64))


class LanguageModel:
    """Log-probabilities of n-gram buckets by language; its size is BUCKETS x languages whatever it is fitted on."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @staticmethod
    def fit(samples: list[tuple[str, str]]) -> LanguageModel:
        counts = np.full((BUCKETS, len(LANGUAGES)), 0.1)
        for k, lang in enumerate(LANGUAGES):
            texts = [bare_prose(t) for x, t in samples if x == lang]
            texts += [plain(t) for t in texts]
            buckets, _ = ngram_buckets([t for t in texts if t])
            counts[:, k] += np.bincount(buckets, minlength=BUCKETS)
        return LanguageModel(np.log(counts / counts.sum(axis=0)).astype(np.float32))

    def scores(self, proses: list[str]) -> np.ndarray:
        """Summed log-probabilities, one row per text."""
        out = np.zeros((len(proses), len(LANGUAGES)))
        for a in range(0, len(proses), 512):
            buckets, owners = ngram_buckets(proses[a : a + 512])
            n = len(proses[a : a + 512])
            for k in range(len(LANGUAGES)):
                out[a : a + n, k] = np.bincount(owners, weights=self.weights[buckets, k], minlength=n)[:n]
        return out

    def languages(self, proses: list[str]) -> list[str | None]:
        """The language of each prose; None where there are too few words; English unless another is clearly likelier."""
        s = self.scores(proses)
        best = s.argmax(axis=1)
        sure = s[np.arange(len(s)), best] - s[:, 0] > MARGIN
        return [LANGUAGES[b if ok else 0] if enough(p) else None for p, b, ok in zip(proses, best, sure, strict=True)]


def labelled_sample(documents: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` documents of at most SAMPLE_BYTES of each language, chosen by hash, for fitting a model.

    The rank filter is pushed below the shuffle, so each task sends at most that many rows of a language.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = documents.where(F.col("lang").isin(*LANGUAGES) & (F.octet_length("text") <= SAMPLE_BYTES)).withColumn("_n", F.row_number().over(order))
    return [(r.lang, r.text) for r in rows.where(F.col("_n") <= per_language).select("lang", "text").collect()]


def fitted_model(documents: DataFrame) -> LanguageModel:
    return LanguageModel.fit(labelled_sample(documents))


def commentary(markers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(origin, file_path, line_number, text): distinct marker contents and raw doc comments."""
    from_markers = markers.select(F.lit("marker").alias("origin"), F.col("source_file").alias("file_path"), "line_number", F.col("content").alias("text"))
    from_symbols = symbols.select(F.lit("symbol").alias("origin"), "file_path", F.col("line_range.start").alias("line_number"), F.col("doc_comment").alias("text"))
    return from_markers.unionByName(from_symbols).where("text IS NOT NULL AND file_path IS NOT NULL AND line_number IS NOT NULL").distinct()


def lexed_at(source: Source, origin: str, line: int, text: str) -> str | None:
    """The comment that a marker's line holds or that is attached to a symbol's, as it stands in the file, if it says ``text``."""
    if not 0 < line <= len(source.starts):
        return None
    if origin == "symbol":
        found = attached(source, line)
        return found if found and description(found) == description(text) else None
    at, end = source.starts[line - 1], source.starts[line] if line < len(source.starts) else len(source.text)
    for a, b in source.comments[max(0, bisect_right(source.comments, (at, 0)) - 1) :]:
        if a >= end:
            break
        if b > at and text in source.text[a:b]:
            return text
    return None


def prose_languages(markers: DataFrame, symbols: DataFrame, files: DataFrame, model: LanguageModel) -> DataFrame:
    """(origin, file_path, line_number, lang, n_bytes, lexed): every marker and doc comment that holds prose.

    ``n_bytes`` is what the comment takes in the source; ``lexed`` tells whether the file's newest version holds it.
    """
    shared = markers.sparkSession.sparkContext.broadcast(model.weights)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = LanguageModel(shared.value)
        for b in batches:
            found: list[tuple] = []
            for path, content, language, items in zip(b["file_path"], b["content"], b["language"], b["items"], strict=True):
                source = Source(content, family(language, path)) if isinstance(content, str) else None
                for i in items:
                    held = lexed_at(source, i["origin"], i["line_number"], i["text"]) if source is not None else None
                    found.append((i["origin"], path, i["line_number"], held or i["text"], held is not None))
            texts = [description(t) if o == "symbol" else t for o, _, _, t, _ in found]
            out = pd.DataFrame([(o, p, n, len(t.encode("utf-8", "replace")), held) for o, p, n, t, held in found], columns=["origin", "file_path", "line_number", "n_bytes", "lexed"])
            out["lang"] = fitted.languages([bare_prose(t) for t in texts]) if found else []
            yield out[out["lang"].notna()]

    pointing = commentary(markers, symbols).select("file_path", F.struct("origin", "line_number", "text").alias("item"))
    return beside_files(pointing, files).mapInPandas(rows, "origin string, file_path string, line_number int, lang string, n_bytes bigint, lexed boolean")


def prose_shares(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, lang, n_bytes, share): bytes of prose by file and language, and their share of the file's bytes.

    A file that is missing, or whose size is unknown, has a null share.
    """
    sizes = latest(files.where("relative_path IS NOT NULL"), "relative_path", ["mtime", "scanned_at"], ["size_bytes"])
    totals = found.groupBy("file_path", "lang").agg(F.sum("n_bytes").alias("n_bytes"))
    share = F.when(F.col("size_bytes") > 0, F.round(F.col("n_bytes") / F.col("size_bytes"), 6))
    joined = totals.join(sizes.withColumnRenamed("relative_path", "file_path"), "file_path", "left")
    return joined.select("file_path", "lang", "n_bytes", share.alias("share"))


def file_prose(files: DataFrame, model: LanguageModel) -> DataFrame:
    """(relative_path, lang, n_parts, n_bytes, share): prose in the comments and strings of whole files, by language.

    Bytes are those of the comments and strings as they stand in the file, marks included.
    """
    shared = files.sparkSession.sparkContext.broadcast(model.weights)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = LanguageModel(shared.value)
        for b in batches:
            out = []
            for path, language, content, mtime, scanned in zip(b["relative_path"], b["language"], b["content"], b["mtime"], b["scanned_at"], strict=True):
                text = content or ""
                parts = [(k, text[x:y]) for k, x, y in tokens(text, family(language, path)) if k in ("comment", "string")]
                proses = [bare_prose(description(p) if k == "comment" else clean_comment(p)) for k, p in parts]
                totals: dict[str, list[int]] = {}
                for (_, part), lang in zip(parts, fitted.languages(proses) if proses else [], strict=True):
                    if lang:
                        t = totals.setdefault(lang, [0, 0])
                        t[0] += 1
                        t[1] += len(part.encode("utf-8", "replace"))
                size = max(1, len(text.encode("utf-8", "replace")))
                parts_out = [{"lang": k, "n_parts": n, "n_bytes": m, "share": round(m / size, 6)} for k, (n, m) in sorted(totals.items())]
                out.append((path, mtime, scanned, parts_out))
            yield pd.DataFrame(out, columns=["relative_path", "mtime", "scanned_at", "parts"])

    schema = "relative_path string, mtime timestamp, scanned_at timestamp, parts array<struct<lang:string,n_parts:bigint,n_bytes:bigint,share:double>>"
    texts = files.where("relative_path IS NOT NULL").select("relative_path", "language", "content", "mtime", "scanned_at")
    newest = latest(texts.mapInPandas(rows, schema), "relative_path", ["mtime", "scanned_at"], ["parts"])
    return newest.select("relative_path", F.inline("parts"))


__all__ = ["LanguageModel", "commentary", "file_prose", "fitted_model", "labelled_sample", "prose_languages", "prose_shares"]
