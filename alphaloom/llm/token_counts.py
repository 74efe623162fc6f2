"""Edit-aware token counts.

A document's text is cut into pre-token pieces at spaces where the vocabulary's pattern always starts anew; runs of
pieces form the leaves of a segment tree whose nodes hold sums of characters and of tokens. An edit descends to the
leaves it touches, takes in neighbours until both borders keep their context, re-encodes that region alone, and
updates the sums above. Counts after any number of edits equal those of encoding the edited text anew.

Defined results: null text is empty and has no tokens; edits are in places of the old text, applied in order; an edit that
begins before the former one ends, or outside the text, or has no start or end, is skipped and counted; a null new text
is empty; edits of the same start and end are applied in the order of their new texts; repeated rows are counted each and
take the same edits; edits without doc_id touch nothing; the edits of one document meet in one task, as its text does; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LEAF = 64
#: A piece begins at a space that follows a non-blank or precedes one.
_BORDER = re.compile(r"(?<!\s)(?= )|(?= \S)")
#: What the query redacts: e-mail addresses, and runs of four digits or more.
REDACT = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[0-9]{4,}")


class TokenTree:
    """Segment tree over leaves of (characters, tokens). Node 1 is the root; leaves begin at `width`."""

    def __init__(self, text: str, count):
        self.text, self.count_piece, self.encoded = text, count, 0
        self._build([(c, t) for c, t in self._leaves(text)])

    def _leaves(self, text: str) -> list[tuple[int, int]]:
        self.encoded += len(text)
        pieces = [p for p in _BORDER.split(text) if p]
        return [(sum(map(len, own)), sum(map(self.count_piece, own))) for own in (pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF))]

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.width = 1
        while self.width < max(1, len(leaves)):
            self.width *= 2
        self.n = len(leaves)
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (c, t) in enumerate(leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = c, t
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; only leaves whose text or border context it touches are encoded again."""
        first, left = self.leaf_at(start)
        while first > 0 and left + 1 >= start:  # a border depends on the character either side of its space
            first -= 1
            left -= self.chars[self.width + first]
        last, at = self.leaf_at(max(start, end - 1))
        right = at + self.chars[self.width + last]
        while last + 1 < self.n and right - 1 < end:
            last += 1
            right += self.chars[self.width + last]
        region = self.text[left:start] + new + self.text[end:right]
        self.text = self.text[:left] + region + self.text[right:]
        leaves = self._leaves(region)
        if len(leaves) <= last - first + 1:  # the region keeps its leaves: update the sums above it
            leaves += [(0, 0)] * (last - first + 1 - len(leaves))
            for k, (c, t) in enumerate(leaves, self.width + first):
                self.chars[k], self.tokens[k] = c, t
            low, high = (self.width + first) // 2, (self.width + last) // 2
            while low:
                for k in range(low, high + 1):
                    self._sum(k)
                low, high = low // 2, high // 2
        else:
            own = list(zip(self.chars[self.width : self.width + self.n], self.tokens[self.width : self.width + self.n]))
            self._build(own[:first] + leaves + own[last + 1 :])


def redactions(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "<email>" if "@" in m[0] else "0") for m in REDACT.finditer(text)]


def edits_of(own: list[dict]) -> list[tuple[int | None, int | None, str]]:
    """Edits in order of their places; those without a place come first."""
    whole = [(e["start"], e["end"], e["new"] or "") for e in own if e["start"] is not None and e["end"] is not None]
    return [(None, None, "")] * (len(own) - len(whole)) + sorted(whole)


def recount(docs: DataFrame, edits: DataFrame | None = None, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, n_edits, n_skipped, n_tokens_after, encoded_again (characters): one row per input row.

    edits: doc_id, start, end, new (characters of the old text). Without them, the redactions of each text are its edits.
    """

    redact = edits is None

    def run(batches):
        from .tokenizer import CACHE, encoder

        enc = encoder(tokenizer)

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                self[piece] = n = len(enc.plain.encode_ordinary(piece)) if not any(s in piece for s in enc.special) else len(enc.whole.encode(piece, add_special_tokens=False).ids)
                return n

        counts = Counts()
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                text = batch.column(1)[i].as_py() or ""
                if len(counts) > CACHE:
                    counts.clear()
                own = redactions(text) if redact else edits_of(batch.column(2)[i].as_py() or [])
                tree = TokenTree(text, counts.__getitem__)
                before, skipped, moved, upto = tree.total, 0, 0, 0
                tree.encoded = 0
                for start, end, new in own:
                    if start is None or start < upto or end < start or end > len(text):
                        skipped += 1
                        continue
                    tree.edit(start + moved, end + moved, new)
                    moved += len(new) - (end - start)
                    upto = end
                rows.append((before, len(own), skipped, tree.total, tree.encoded))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_tokens", "n_edits", "n_skipped", "n_tokens_after", "encoded_again"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if edits is not None:
        place = edits.select(F.col("doc_id").cast("long"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new").cast("string").alias("new")).alias("edit"))
        own = place.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list("edit").alias("edits"))
        rows = rows.join(own, "doc_id", "left")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_skipped long, n_tokens_after long, encoded_again long")
