"""Hierarchical packing of token ids into windows of several context sizes, balanced into step groups."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import text_rows

#: Context sizes; a window of the longest holds whole parts of long documents, shorter ones hold what the longer leave.
CONTEXTS = (256, 512, 1024, 2048)
#: Tokens that a task packs at a time, and tokens of one training step.
UNIT, STEP = 1 << 20, 1 << 15
#: Words whose ids a worker remembers, and the longest of them in bytes.
KNOWN, KNOWN_BYTES = 600_000, 40
PART = 4_000_000

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n\r\t", b"abcdefghijklmnopqrstuvwxyz   ")
BLANK = bytes.maketrans(b"\n\r\t", b"   ")
#: A run that ends in a letter before a blank, stop or comma, or else whatever comes up to a blank.
CHUNK = re.compile(rb"[a-z\x80-\xff]+(?:(?<=[a-z])|(?<=\xc3[\xa0-\xb6\xb8-\xbf]))(?=[ .,]|$)|[^ ]+")
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")


class WordIds:
    """Ids of whole texts, word by word: little-endian unsigned 32-bit ids, equal to the library's.

    The tokenizer drops white space and never joins what it separates, nor a letter with a stop or comma after it, so a
    text is cut there and the ids of each chunk are looked up. It composes characters, then lower-cases; lower-casing A-Z
    first is the same unless a combining mark (U+0300 to U+036F) follows or the text holds "<|", which may start a special
    token: such texts keep their capitals. Unknown plain words are encoded as one text, in which a piece with the
    end-of-word mark ends each; other chunks one by one.
    """

    def __init__(self, tokenizer: str):
        self.lib = Tokenizer.from_str(tokenizer)
        self.ends = np.zeros(self.lib.get_vocab_size() + 1, bool)
        for piece, i in self.lib.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def chunks(self, text: str) -> list[bytes]:
        data = text.encode("utf-8", "replace")
        fold = not (b"<|" in data or b"\xcc" in data or b"\xcd" in data)
        return CHUNK.findall(data.translate(FOLD if fold else BLANK))

    def learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if PLAIN.fullmatch(w)]
        if plain:
            ids = np.array(self.lib.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(plain):
                raise ValueError("the tokenizer does not end each word with a piece of its own")
            data, before = ids.tobytes(), 0
            for w, stop in zip(plain, stops.tolist(), strict=True):
                self.known[w] = data[4 * before : 4 * stop]
                before = stop
        odd = [w for w in words if w not in self.known]
        for w, e in zip(odd, self.lib.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as bytes; texts are cut into chunks a few megabytes at a time."""
        lo = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= PART or i == len(texts) - 1:
                parts = [self.chunks(t) for t in texts[lo : i + 1]]
                if len(self.known) > KNOWN:
                    self.known.clear()
                new = set().union(*parts).difference(self.known)
                self.learn(list(new))
                for p in parts:
                    yield b"".join(map(self.known.__getitem__, p))
                for w in new:
                    if len(w) > KNOWN_BYTES:
                        del self.known[w]
                lo, held = i + 1, 0


@lru_cache(maxsize=2)
def word_ids(tokenizer: str) -> WordIds:
    return WordIds(tokenizer)


class Packer:
    """Windows of one task, numbered from `first`. Every window is exactly full; pieces are (document, start, length)."""

    def __init__(self, contexts: tuple[int, ...], first: int, step_tokens: int):
        self.contexts, self.step_tokens = sorted(contexts), step_tokens
        self.next_window = self.next_step = first
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), shortest first
        self.tokens = 0
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []  # (context, pieces)
        self.done_tokens = 0

    def close(self, context: int, pieces: list[tuple[int, int, int]]) -> None:
        self.done.append((context, pieces))
        self.done_tokens += context

    def wait(self, length: int, doc: int, start: int) -> None:
        insort(self.waiting, (length, doc, start))
        self.tokens += length

    def add(self, doc: int, length: int) -> None:
        """Whole windows of the longest context at once; the rest waits in the tier of its length."""
        top, start = self.contexts[-1], 0
        while length - start >= top:
            self.close(top, [(doc, start, top)])
            start += top
        if start < length:
            self.wait(length - start, doc, start)

    def take(self, gap: int) -> tuple[int, int, int]:
        """The longest waiting part that fits the gap, else the head of the longest part, whose rest goes on waiting."""
        at = bisect_right(self.waiting, (gap, 1 << 62, 0))
        length, doc, start = self.waiting.pop(at - 1 if at else -1)
        self.tokens -= length
        if length > gap:
            self.wait(length - gap, doc, start + gap)
        return doc, start, min(length, gap)

    def pack(self, last: bool) -> None:
        """Fills windows from the longest tier down: a part opens a window of the least context that holds it, shorter parts fill its gap.

        What the last open window holds goes on waiting, or, in the last unit, is broken at powers of two.
        """
        while self.waiting:
            need = self.waiting[-1][0]
            context = next(c for c in self.contexts if c >= need)
            if self.tokens < context:
                if not last:
                    return
                context = 1 << (self.tokens.bit_length() - 1)
            pieces, gap = [], context
            while gap:
                pieces.append(self.take(gap))
                gap -= pieces[-1][2]
            self.close(context, pieces)

    def flush(self) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(window, context, step, pieces) of the closed windows. Windows of one context are dealt to steps of step_tokens, to
        and fro by falling attention cost (squared piece lengths), so that steps of a context cost about the same."""
        for context in sorted({c for c, _ in self.done}):
            windows = sorted((p for c, p in self.done if c == context), key=lambda p: (-sum(n * n for _, _, n in p), p))
            steps = -(-len(windows) * context // max(self.step_tokens, context))
            for i, pieces in enumerate(windows):
                turn, place = divmod(i, steps)
                yield self.next_window + i, context, self.next_step + (steps - 1 - place if turn % 2 else place), pieces
            self.next_window += len(windows)
            self.next_step += steps
        self.done, self.done_tokens = [], 0


def pack_documents(
    df: DataFrame, tokenizer_path: str, end_id: int = 1, contexts: tuple[int, ...] = CONTEXTS, step_tokens: int = STEP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, context, step, ids (binary, little-endian
    unsigned 32-bit).

    A document is the tokenizer's ids of its whole text and end_id. Each task packs its own rows, some million tokens at a
    time, so nothing is shuffled and no group grows with the data; a task holds one unit besides the input batch. The
    longest context cuts whole windows off long documents, what remains is routed to tiers and packed from the longest
    tier down. All windows are exactly full: only the last open window of a task is broken, at powers of two.
    sequence_id and step carry the partition's number in their upper bits; both are unique, neither is gapless over the table.
    Null and empty texts are the end id alone; repeated rows are documents of their own; null ids stay null; other columns are
    ignored; an empty table gives no rows. The tokenizer (a few megabytes) is read on the driver and sent with the function.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    end = np.array([end_id], "<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, packer = word_ids(tokenizer), Packer(contexts, TaskContext.get().partitionId() << 33, step_tokens)
        docs: dict[int, tuple[object, bytes]] = {}  # documents of which some part is not written yet
        n = 0

        def out() -> pd.DataFrame:
            rows = []
            for window, context, step, pieces in packer.flush():
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids = docs[doc]
                    rows.append((doc_id, start, length, len(ids) // 4, window, offset, context, step, ids[4 * start : 4 * (start + length)]))
                    offset += length
            live = {doc for _, doc, _ in packer.waiting}
            for doc in [d for d in docs if d not in live]:
                del docs[doc]
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "context", "step", "ids"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for f in frames:
            for doc_id, ids in zip(f["doc_id"].astype("Int64"), words.encode_all(f["text"].tolist()), strict=True):
                docs[n] = (doc_id, ids + end)
                packer.add(n, len(ids) // 4 + 1)
                n += 1
                if packer.tokens + packer.done_tokens >= UNIT:
                    packer.pack(False)
                    yield out()
        packer.pack(True)
        yield out()

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, context int, step long, ids binary"
    return text_rows(df, id_col, text_col).mapInPandas(run, schema)
