"""Exact token counts at every prefix of a text, for BPE vocabularies with byte fallback.

The encoding of a prefix is determined by its last token: token `t` ends the encoding of prefix `i` exactly
if `t` is a suffix of it and the pair (last token of prefix `i - len(t)`, `t`) encodes to itself. One pass
over the characters therefore stores the last token and the count of every prefix, and truncation or budget
questions are answered by look-up. Texts are handled in units that no piece of the vocabulary crosses (a run
of spaces and the characters after it); the prefix counts of a unit are kept for its next occurrence.

Null and empty texts have no token; extra columns are ignored by `count_tokens` and kept by `truncate_texts`.
"""

from __future__ import annotations

import re
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.frames import arrow_map

SPACE = "▁"
KEPT_UNITS = 1_000_000
KEPT_PAIRS = 4_000_000


class PrefixCounter:
    """Prefix counts under the vocabulary of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not special(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece crosses the start of a word; texts can't be cut into units")
        self.pieces = ahocorasick.Automaton()
        for piece in self.score:
            self.pieces.add_word(piece, piece)
        self.pieces.make_automaton()
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs: dict[tuple[str, str], bool] = {}
        counter = self

        class Units(dict):
            def __missing__(self, unit: str) -> tuple[int, ...]:
                if len(self) >= KEPT_UNITS:
                    self.clear()
                found = self[unit] = counter.prefixes(unit)
                return found

        class Totals(dict):
            def __missing__(self, unit: str) -> int:
                if len(self) >= KEPT_UNITS:
                    self.clear()
                found = self[unit] = counter.prefixes(unit)[-1]
                return found

        self.units, self.totals = Units(), Totals()

    def merge(self, text: str) -> list[str]:
        """Merges the best-scored neighbours, the leftmost first among equals, until none can be merged."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether `left` and `right` stay as they are when their concatenation is encoded."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(left + right) == ([left, right] if left else [right])
        return found

    def prefixes(self, unit: str) -> tuple[int, ...]:
        """Token counts of unit[:1], unit[:2], ... unit."""
        n = len(unit)
        last, count = [""] + [None] * n, [0] * (n + 1)
        pairs, done = self.pairs, 0
        for end, token in self.pieces.iter(unit):  # by end, the longest first
            end += 1
            while done < end - 1:
                done += 1
                if last[done] is None:
                    self.unknown(unit, done, last, count)
            if last[end] is None:
                start = end - len(token)
                if start and last[start] is None:
                    self.unknown(unit, start, last, count)
                key = (last[start], token)
                if pairs[key] if key in pairs else self.fits(*key):
                    last[end], count[end] = token, count[start] + 1
        for end in range(done + 1, n + 1):
            if last[end] is None:
                self.unknown(unit, end, last, count)
        return tuple(count[1:])

    def unknown(self, unit: str, end: int, last: list, count: list) -> None:
        """The bytes of a character that is no piece."""
        token = unit[end - 1]
        if token in self.score:
            raise ArithmeticError(f"no token ends prefix {end} of {unit!r}")
        last[end], count[end] = token, count[end - 1] + len(token.encode("utf-8", "surrogatepass"))

    def cut(self, text: str) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def total(self, text: str | None) -> int:
        return sum(map(self.totals.__getitem__, self.cut(text))) if text else 0

    def every_prefix(self, text: str | None) -> list[int]:
        """Token counts of text[:1], text[:2], ... text."""
        out, before = [], 0
        for unit in self.cut(text) if text else ():
            out.extend(before + n for n in self.units[unit])
            before = out[-1]
        return out[1:]  # without the space that the model puts before the text


def counter(model: str) -> PrefixCounter:
    """One counter for each Python worker and model."""
    kept = sys.modules.setdefault("_llm_prefix_counters", types.ModuleType("_llm_prefix_counters"))
    if model not in kept.__dict__:
        setattr(kept, model, PrefixCounter(model))
    return getattr(kept, model)


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8) and n_tokens of the whole text."""

    def count(batch: pa.RecordBatch) -> dict:
        c = counter(model)
        n = [c.total(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(n, pa.int64())}

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return arrow_map(source, count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("doc_id", key)


def prefix_counts(model: str) -> callable:
    """A column function: text -> token count of each of its prefixes, in characters."""

    @F.pandas_udf("array<int>")
    def counts(texts):
        c = counter(model)
        return texts.map(c.every_prefix)

    counts_of: callable = lambda text: counts(F.coalesce(text, F.lit("")))
    return counts_of


def tokens_before(prefixes: Column, chars: Column) -> Column:
    """Tokens of the first `chars` characters, from stored prefix counts."""
    return F.when(chars <= 0, 0).otherwise(F.coalesce(F.get(prefixes, F.least(chars, F.size(prefixes)) - 1), F.lit(0)))


def chars_within(prefixes: Column, budget: Column) -> Column:
    """Length of the longest prefix that has at most `budget` tokens, from stored prefix counts."""
    return F.coalesce(F.array_max(F.transform(prefixes, lambda n, i: F.when(n <= budget, i + 1))), F.lit(0))


def truncate_texts(docs: DataFrame, model: str, budget: int, text: str = "text") -> DataFrame:
    """`docs` with each text cut to its longest prefix of at most `budget` tokens; null stays null."""
    prefixes = prefix_counts(model)(F.col(text))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), F.substr(text, F.lit(1), chars_within(prefixes, F.lit(budget)))))
