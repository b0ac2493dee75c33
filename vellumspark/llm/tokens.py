"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a piece of text (a piece is what the pre-tokenizer splits off) the table keeps the last token of
that prefix's encoding and its token count. Prefix i ends with the one token t for which t may follow the last token of
prefix i - len(t); so each count follows from an earlier one, and no prefix is encoded again. Counts of pieces add up
along a text, which gives truncation points and budget answers from the same table.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The splitting pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Printable stand-ins that such vocabulary files use for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter(dict):
    """Maps a piece to its token count; a missing piece is counted by the prefix table and kept while room lasts."""

    def __init__(self, spec: str, room: int = 400_000):
        super().__init__()
        model = json.loads(spec)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.specials = [t["content"] for t in model.get("added_tokens", [])]
        self.pattern = regex.compile(PIECES)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.made = {a + b: (k, a, b) for (a, b), k in reversed(self.rank.items())}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.whole = {bytes([b]) for b in range(256)} | {t for t in self.made if self.merged(t) == [t]}
        self.finder = ahocorasick.Automaton()
        for t in self.whole:
            self.finder.add_word(t.decode("latin-1"), t)
        self.finder.make_automaton()
        self.room = room

    def merged(self, b: bytes) -> list[bytes]:
        """The encoding of a short byte string by merging the lowest-ranked neighbours first."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            ranked = [(self.rank.get((parts[i], parts[i + 1]), 1 << 40), i) for i in range(len(parts) - 1)]
            best, _ = min(ranked)
            if best == 1 << 40:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.rank.get((parts[i], parts[i + 1])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether a then b is the encoding of a + b.

        Undoes the merges on either side of the border from the latest back; a pair across the border that ranks before
        the merge just undone would have been joined first. Of equal ranks the leftmost pair is joined first.
        """
        known = self.follows.get((a, b))
        if known is not None:
            return known
        if len(self.follows) > 2 * self.room:
            self.follows.clear()
        x, y, never = a, b, 1 << 40
        ok = (x, y) not in self.rank
        while ok:
            mx, my = self.made.get(x), self.made.get(y)
            if mx is None and my is None:
                break
            if my is None or mx is not None and mx[0] > my[0]:
                x = mx[2]
                ok = self.rank.get((x, y), never) >= mx[0]
            else:
                y = my[1]
                ok = self.rank.get((x, y), never) > my[0]
        self.follows[a, b] = ok
        return ok

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of every prefix of one piece, the empty one first."""
        last, counts = [b""], [0]
        follows = self.follows
        for at, t in self.finder.iter(piece.decode("latin-1")):
            if len(last) == at + 2:
                continue
            start = at + 1 - len(t)
            if start:
                known = follows.get((last[start], t))
                if not (known or known is None and self.may_follow(last[start], t)):
                    continue
            last.append(t)
            counts.append(counts[start] + 1)
        return counts

    def __missing__(self, piece: str) -> int:
        n = self.prefix_counts(piece.encode())[-1]
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        """Pieces in order; a special token's string is a piece of its own."""
        if self.special_pattern is None or not any(s in text for s in self.specials):
            return self.pattern.findall(text)
        out: list[str] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def counts(self, pieces: list[str]) -> list[int]:
        return [1 if p in self.specials else self[p] for p in pieces] if any(s in pieces for s in self.specials) else list(map(self.__getitem__, pieces))

    def truncation(self, pieces: list[str], counts: list[int], limit: int) -> int:
        """Bytes of the text up to the point where the running count would first pass the limit.

        Whole pieces come from the running sum, the rest from the prefix table of the piece that crosses the limit; the
        cut falls between characters.
        """
        total = size = 0
        for p, n in zip(pieces, counts):
            if total + n > limit:
                if p in self.specials:
                    return size
                b = p.encode()
                inside = self.prefix_counts(b)
                first_over = next(i for i, c in enumerate(inside) if total + c > limit)
                cut = first_over - 1
                while cut and cut < len(b) and b[cut] & 0xC0 == 0x80:
                    cut -= 1
                return size + cut
            total += n
            size += len(p.encode())
        return size


    def every_prefix(self, text: str) -> list[int]:
        """Token count of the pieces so far, at every byte of the text from 0 on."""
        out, total = [0], 0
        for p in self.split(text):
            inside = [0] * len(p.encode()) + [1] if p in self.specials else self.prefix_counts(p.encode())
            out += [total + n for n in inside[1:]]
            total += inside[-1]
        return out


@functools.lru_cache(maxsize=2)
def _counter(spec: str) -> PrefixCounter:
    """One a worker process, kept from task to task."""
    return PrefixCounter(spec)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact token counts of whole texts, one row a document: doc_id, n_bytes, n_tokens, over_limit, cut_bytes.

    tokenizer_path names a byte-level BPE file of the tokenizers library; the driver reads it (about 2 MB, the same for
    any input) and broadcasts it. cut_bytes is the length in bytes of the prefix that fits the limit.

    Null and empty texts have 0 bytes and 0 tokens. A string of a special token inside a text counts as that token.
    Repeated rows give repeated results; null ids stay null; other columns are not read. An empty table gives no rows.
    The job is one scan without a shuffle.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            size, tokens, cuts = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                pieces = counter.split(text)
                counts = counter.counts(pieces)
                n, b = sum(counts), len(text.encode())
                size.append(b)
                tokens.append(n)
                cuts.append(b if n <= limit else counter.truncation(pieces, counts, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(cuts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")


def prefix_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token count at every byte prefix of whole texts: doc_id, and prefix_tokens with one entry more than bytes.

    Entry i is the number of tokens of the first i bytes, split into pieces as in the whole text; the last is the text's
    own count. Inside a special token's string it does not grow before the end. Null and empty texts have one entry, 0.
    The table answers any number of budget questions (bytes_within, tokens_between) without encoding again; it takes
    about as much room as the text, so keep it only where there are several. Otherwise as token_counts().
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = [counter.every_prefix(text.as_py() or "") for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tables, "doc_id long, prefix_tokens array<int>")


def bytes_within(prefix_tokens: Column, budget: int) -> Column:
    """Bytes of the longest prefix before the count first passes the budget."""
    over = F.array_position(F.transform(prefix_tokens, lambda n: n > budget), True)
    return F.when(over > 0, over - 2).otherwise(F.size(prefix_tokens) - 1).cast("long")


def tokens_between(prefix_tokens: Column, start: Column | int, end: Column | int) -> Column:
    """Tokens that end in the byte range from start to end: an estimate of a slice's cost from two entries."""
    at = lambda i: F.get(prefix_tokens, F.greatest(F.lit(0), F.least(F.lit(i) if isinstance(i, int) else i, F.size(prefix_tokens) - 1)))
    return at(end) - at(start)
