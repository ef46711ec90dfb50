"""Token counts by whole-token shortcut.

Which strings of the vocabulary encode alone as one token is proved once, on the
driver, by encoding every one of them with the library; the proven set is broadcast
(its size is the vocabulary's, not the data's).  On the executors the distinct words of a
task's texts (no pre-token crosses white space) are cut into the tokenizer's own
pre-tokens; one that is in the proven set counts 1, and only the rest is merged by the
library, once for each distinct string.

A word is cut here only if it is certain that the cut equals the library's: it has no
string of an added token, is in normal form C, and each of its characters was tried
with the library's own normalizer and pre-tokenizer.  Any other word is encoded
by the library as it stands.

Edge cases: a null or empty text has 0 tokens and 0 bytes; repeated rows and null
ids keep their rows; texts of any length are taken whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import table

#: The pre-tokens of the word-level vocabulary (fixed by its file): contractions,
#: runs of letters, single digits, runs of other visible characters.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distinct strings whose counts a task remembers; it starts anew beyond that.
REMEMBERED = 1_000_000


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def proven_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings with a word end that the library encodes as just that token."""
    t = load(path)
    words = [w[: -len("</w>")] for w in t.get_vocab() if w.endswith("</w>")]
    found = set()
    for at in range(0, len(words), 5000):
        part = words[at : at + 5000]
        for w, e in zip(part, t.encode_batch(part, add_special_tokens=False), strict=True):
            if len(e.ids) == 1 and regex.fullmatch(PRE_TOKEN, w):
                found.add(w)
    return frozenset(found)


class Counting:
    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.whole = load(path), whole
        self.cut = regex.compile(PRE_TOKEN).findall
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self.tried: dict[str, bool] = {}

    def certain(self, ch: str) -> bool:
        """Whether the library cuts and lowers this character as it is done here."""
        if unicodedata.combining(ch) or ch in "Σİ":
            return False
        norm, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        probe = f"a{ch}b {ch} 1{ch}!{ch}{ch}"
        lowered = norm.normalize_str(probe)
        if lowered.split() != probe.lower().split():
            return False
        theirs = [lowered[a:b] for _, (a, b) in pre.pre_tokenize_str(lowered)]
        return [x for x in theirs if x.strip()] == self.cut(lowered)

    def plain(self, text: str) -> bool:
        for ch in set(text) - self.tried.keys():
            self.tried[ch] = self.certain(ch)
        return all(self.tried[ch] for ch in set(text)) and (text.isascii() or unicodedata.is_normalized("NFC", text)) and not any(a in text for a in self.added)

    def merged(self, pieces: list[str]) -> list[int]:
        """How many tokens the library makes of each pre-token."""
        out: list[int] = []
        for at in range(0, len(pieces), 10_000):
            part = pieces[at : at + 10_000]
            of = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).word_ids, np.int64)
            n = np.bincount(of, minlength=len(part))
            if len(n) != len(part) or not n.all():  # a piece isn't one pre-token after all
                n = np.array([len(x.ids) for x in self.tokenizer.encode_batch(part, add_special_tokens=False)])
            out += n.tolist()
        return out

    def learn(self, words: list[str]) -> None:
        """Remembers the counts of words (runs of anything but ASCII white space)."""
        known, whole = self.known, self.whole
        if len(known) > REMEMBERED:
            known.clear()
        words = [w for w in words if w not in known]
        if not self.plain("\n".join(words)):
            plain = []
            for w in words:
                if self.plain(w):
                    plain.append(w)
                else:  # the library cuts and merges all of it
                    known[w] = len(self.tokenizer.encode(w, add_special_tokens=False).ids)
            words = plain
        single: dict[str, list[str]] = {}
        several: list[tuple[str, list[str]]] = []
        pieces: dict[str, int] = {}
        for w in words:
            low = w.lower()
            if low in whole:
                known[w] = 1
            elif low.isalpha():
                single.setdefault(low, []).append(w)
                pieces[low] = 0
            else:
                parts = self.cut(low)
                rest = [p for p in parts if p not in whole]
                known[w] = len(parts) - len(rest)
                if rest:
                    several.append((w, rest))
                    pieces.update(dict.fromkeys(rest, 0))
        pieces = dict(zip(pieces, self.merged(list(pieces)), strict=True))
        for low, same in single.items():
            known.update(dict.fromkeys(same, pieces[low]))
        for w, rest in several:
            known[w] += sum(map(pieces.__getitem__, rest))

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = []
        for docs in textvec.steps(texts):
            w = textvec.words(docs)
            codes, strings = textvec.distinct(docs, w.start, w.end)
            self.learn(strings)
            each = np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))
            out.append(textvec.sums(each[codes], w.first))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    whole = docs.sparkSession.sparkContext.broadcast(proven_whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(path, whole.value)
        for batch in batches:
            n = pa.array(counting.counts(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
