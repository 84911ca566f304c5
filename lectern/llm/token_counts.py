"""Token counts by a finite-state compilation of a piece vocabulary.

The transducer reads a word character by character. Its state stands for a prefix; each transition carries the
change of the emitted-token count. The last token of a prefix is the one suffix piece that is compatible with the
last token of what stands before it (two neighbours are compatible if merging their joined text gives them back),
so a state needs no merge loop over the word. States are compiled when first reached.

A text is cut into chunks of fixed length. A chunk's state map is (head, count, tail): the open word it ends, the
tokens of its whole words, the open word it leaves. Maps compose associatively, and a prefix scan over the chunks
gives the count of the text.
"""

from __future__ import annotations

import heapq
import re
from collections import deque

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table, whole_texts
from .pieces import text_slices

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
CHUNK = 1 << 15
MAX_STATES = 1_000_000
MAX_WORDS = 800_000
LONG_WORD = 64  # longer words are neither compiled into states nor remembered
_UNITS = re.compile(r" *[^ ]+| +")


class Transducer:
    """Deterministic token-count transducer of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usable = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces of this vocabulary cross word borders")
        by_score = sorted((p for p in self.score if SPACE not in p[1:]), key=lambda p: -self.score[p])
        self.rank: dict[str, int] = {}  # of pieces that merging can make; smaller merges first
        self.halves: list[tuple[str, str] | None] = []
        for p in by_score:
            steps = self.merged(p, keep=True)
            if len(p) == 1 or steps and steps[-1][0] + steps[-1][1] == p:
                self.rank[p] = len(self.halves)
                self.halves.append(steps[-1] if len(p) > 1 else None)
        self.longest = max(map(len, self.rank))
        self._clear()

    def _clear(self) -> None:
        self.next: dict[int, int] = {}
        self.count, self.last = [0], [""]

    def merged(self, text: str, keep: bool = False) -> list:
        """Plain merging by score, leftmost first among equals; with `keep`, the merges in order."""
        parts, steps = list(text), []
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return steps if keep else parts
            i = -best[1]
            steps.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def merged_by_heap(self, text: str) -> list[str]:
        """The same parts in n log n steps: pairs wait by score and place, and vanished neighbours are passed over."""
        n, score = len(text), self.score
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
        end.append(n + 1)
        heap = [(-score[text[i : i + 2]], i, i + 2) for i in range(n - 1) if text[i : i + 2] in score]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle >= stop or middle < 0 or end[middle] != stop:  # one of the two has changed
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if text[i : end[stop]] in score:
                    heapq.heappush(heap, (-score[text[i : end[stop]]], i, end[stop]))
            left = before[i]
            if left >= 0 and text[left:stop] in score:
                heapq.heappush(heap, (-score[text[left:stop]], left, stop))
        parts, at = [], 0
        while at < n:
            parts.append(text[at : end[at]])
            at = end[at]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether a, b stay apart: the later-made of the two is undone until no merge across the border comes first."""
        rank, halves = self.rank, self.halves
        ra, rb = rank.get(a), rank.get(b)
        if ra is None or rb is None:
            return True
        limit = 1 << 30
        while True:
            if rank.get(a + b, 1 << 30) < limit:
                return False
            split_a = halves[ra] if ra > rb else None
            if split_a is None and halves[rb] is not None:
                limit, b = rb + 1, halves[rb][0]
                rb = rank[b]
            elif halves[ra] is not None:
                limit, a = ra, halves[ra][1]
                ra = rank[a]
            else:
                return True

    def _compile(self, word: str, end: int, states: list[int]) -> int:
        for size in range(min(self.longest, end), 0, -1):
            piece = word[end - size : end]
            known = piece in self.rank
            if not known and size > 1:
                continue
            before = states[end - size]
            if before == 0 or self.compatible(self.last[before], piece):
                self.count.append(self.count[before] + (1 if known else len(piece.encode("utf-8"))))
                self.last.append(piece)
                return len(self.count) - 1
        raise AssertionError(f"no compatible last token in {word[:end]!r}")

    def _long(self, word: str) -> int:
        """The same walk without keeping states: a transition looks back at most the longest piece."""
        counts, lasts = deque([0], self.longest), deque([""], self.longest)
        for end in range(1, len(word) + 1):
            for size in range(len(counts), 0, -1):
                piece = word[end - size : end]
                known = piece in self.rank
                if not known and size > 1:
                    continue
                if end == size or self.compatible(lasts[-size], piece):
                    break
            else:
                raise AssertionError(f"no compatible last token at {end}")
            counts.append(counts[-size] + (1 if known else len(piece.encode("utf-8"))))
            lasts.append(piece)
        return counts[-1]

    def word(self, word: str) -> int:
        """Tokens of one unit: spaces, already written as the space mark, then characters that are not spaces."""
        if SPACE in word[1:]:  # runs of the space mark have pieces of equal score, so no merge hides another
            return sum(1 if p in self.score else len(p.encode("utf-8")) for p in self.merged_by_heap(word))
        if len(word) > LONG_WORD:
            return self._long(word)
        if len(self.count) > MAX_STATES:
            self._clear()
        state, states, follow = 0, [0], self.next
        for i, ch in enumerate(word):
            key = state << 21 | ord(ch)
            to = follow.get(key)
            if to is None:
                to = follow[key] = self._compile(word, i + 1, states)
            state = to
            states.append(state)
        return self.count[state]


class _Words(dict):
    """Words after one space -> tokens; `raw` holds units as they stand."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.raw = machine, {}

    def __missing__(self, word: str) -> int:
        n = self.machine.word(SPACE + word.replace(" ", SPACE))
        if len(word) <= LONG_WORD:
            self[word] = n
        return n

    def unit(self, unit: str) -> int:
        n = self.raw.get(unit)
        if n is None:
            n = self.machine.word(unit.replace(" ", SPACE))
            if len(unit) <= LONG_WORD:
                self.raw[unit] = n
        return n


class TokenCounter:
    def __init__(self, model_file: str):
        self.words = _Words(Transducer(model_file))

    def fragment(self, text: str) -> int:
        """Tokens of a stretch whose ends are word borders."""
        words, total, first = self.words, 0, True
        get = words.__getitem__
        for line in text.split("\n"):
            if not first:
                total += 1  # the newline itself, one fallback byte
            first = False
            if not line:
                continue
            if "  " in line:
                total += sum(map(words.unit, _UNITS.findall(line)))
                continue
            head, *rest = line.split(" ")
            if head:
                total += words.unit(head)
            total += sum(map(get, rest))
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(open word it ends, tokens of whole words, open word it leaves); count None: no border inside."""
        start = re.search(r"[ \n]", chunk[1:])
        if start is None:
            return chunk, None, ""
        first = start.start() + 1
        last = max(chunk.rfind(" "), chunk.rfind("\n"))
        while last > first and chunk[last - 1] == " ":
            last -= 1
        if chunk[first - 1] == " ":  # a run of spaces goes on
            return chunk, None, ""
        return chunk[:first], self.fragment(chunk[first:last]) if last > first else 0, chunk[max(first, last) :]

    def compose(self, a, b):
        """Associative composition of two state maps."""
        if a[1] is None and b[1] is None:
            return self.chunk_map(a[0] + b[0])
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.fragment(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if len(self.words) + len(self.words.raw) > MAX_WORDS:
            self.words.clear()
            self.words.raw.clear()
        text = " " + text.replace(SPACE, " ")
        if len(text) <= chunk:
            return self.fragment(text)
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:  # balanced scan: each round composes neighbours
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, body, tail = maps[0]
        return self.fragment(head) if body is None else self.fragment(head) + body + self.fragment(tail)


_counters: dict[str, TokenCounter] = {}


def token_counts(df: DataFrame, model_file: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of (doc_id, text); other columns are not read.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives no rows;
    a null doc_id stays null. One pass over the scan's own partitions, no shuffle.
    """
    model_file = model_file or public_tokenizers.path(MODEL)

    def run(batches):
        import pyarrow as pa

        counter = _counters.get(model_file)
        if counter is None:
            counter = _counters[model_file] = TokenCounter(model_file)
        for batch in batches:
            for ids, texts in text_slices(batch):
                n = [counter.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return whole_texts(df).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
