"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by an incremental UTF-8 machine.

The merges define a nondeterministic transducer over bytes. A configuration is the last whole token and a place within the token
being read. A token may end only if it stays apart from the one before it, that is, if no merge of the two tokens' bytes together
crosses the seam (`Transducer.apart`). A sequence of tokens is the BPE encoding of its bytes just when all its neighbours stay apart,
and each prefix of a text has one such sequence, so at every byte there is one token that ends there, and as many configurations as
there are tokens still open.

`Transducer` determinises it as texts need it: a state is a set of configurations, a move gives the next state and the token that ends
there. The paths of all configurations lead back through those tokens; where they have met, tokens are written. An open token is no
longer than the longest token, so this looks ahead a bounded number of bytes, what is held back is bounded, and an input of any length
takes time in proportion to it. States made are kept up to MOST_STATES, then made anew as they are met; results don't depend on it.

Text is split by a pattern first; each match is encoded by itself. Long texts are taken in parts that end before white space, where no
match can lie across. `decode` writes a text as soon as the machine is between characters; bytes that are no UTF-8 become U+FFFD.

Defined cases: a null text is encoded as an empty one; a null id list decodes to null; equal rows give equal rows; an empty table gives
none; other columns are not returned. Ranks must have every single byte, and no token may rank below the two it is merged from.
"""
from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import row_slices, small_batches

MOST_STATES, MOST_PIECES, LONGEST_PIECE = 300_000, 400_000, 64
PART, BLOCK, WINDOW = 1 << 16, 1 << 16, 512
CONFIGS = -1
NONE = -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES, window: int = WINDOW):
        self.ranks, self.most, self.window = ranks, most_states, window
        self.token = {rank: token for token, rank in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no rank for byte {missing[0]}")
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.parts, self.seams = {}, {}
        # of each trie node: the node after a byte, the token that ends there (-1: none) and whether longer ones go on
        self.after: list[dict[int, tuple[int, int, bool]] | None] = [{}]
        self.depth = [0]
        for token, rank in sorted(ranks.items(), reverse=True):  # longer tokens before those they begin with
            node = 0
            for depth, b in enumerate(token, 1):
                if self.after[node] is None:
                    self.after[node] = {}
                step = self.after[node].get(b)
                if step is None:
                    step = len(self.depth), -1, depth < len(token)
                    self.after.append(None)
                    self.depth.append(depth)
                if depth == len(token):
                    step = step[0], rank, step[2]
                self.after[node][b] = step
                node = step[0]
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((NONE, 0),))

    def _state(self, configs: tuple) -> dict:
        """The state of configurations, each a token before (NONE: none) and a trie node within the open one; first the one at a seam. A state
        maps bytes to moves, and CONFIGS to what it stands for."""
        found = self.states.get(configs)
        if found is None:
            found = self.states[configs] = {CONFIGS: configs}
        return found

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """BPE by its definition: the pair of least rank is merged, the first of equals, until none or `least` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], float("inf")), i) for i in range(len(parts) - 1))
            if rank == float("inf"):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens merged last to make this one; of a byte, and of a token that its own bytes don't give, none."""
        if token not in self.parts:
            data = self.token[token]
            parts = [self.ranks[x] for x in self.merged(data, 2)]
            if len(data) == 1 or len(parts) > 2:
                self.parts[token] = None
            else:
                if any(len(self.token[x]) > 1 and x > token for x in parts):
                    raise ValueError(f"token {token} ranks below a token it is merged from")
                self.parts[token] = tuple(parts)
        return self.parts[token]

    def made(self, token: int) -> bool:
        return len(self.token[token]) == 1 or self.halves(token) is not None

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens in a row (a: NONE for none) give just these two.

        Merges of both are undone from the latest back. Of two neighbours x, y at the seam, x would be merged into a longer token at rank
        `left` and y at rank `right`; a merge of x with y comes before both if it ranks below `left` (at equal ranks the first is merged) and
        not above `right`.
        """
        seam = a << 32 | b
        if seam not in self.seams:
            if len(self.seams) > 4 * self.most:
                self.seams.clear()
            self.seams[seam] = self.made(b) and (a == NONE or self._apart(a, b))
        return self.seams[seam]

    def _apart(self, x: int, y: int) -> bool:
        ranks, token, left, right = self.ranks, self.token, float("inf"), float("inf")
        while True:
            across = ranks.get(token[x] + token[y])
            if across is not None and across < left and across <= right:
                return False
            of_x, of_y = self.halves(x), self.halves(y)
            if of_x is None and of_y is None:
                return True
            if of_x is None or (of_y is not None and y >= x):
                right, y = y, of_y[0]
            else:
                left, x = x, of_x[1]

    def _move(self, state: dict, b: int) -> tuple[dict, int]:
        configs, seam, after, seams = [None], NONE, self.after, self.seams
        for before, node in state[CONFIGS]:
            step = after[node].get(b)
            if step is None:
                continue
            node, end, longer = step
            if longer:
                configs.append((before, node))
            if end >= 0 and seam < 0:
                fits = seams.get(before << 32 | end)
                if self.apart(before, end) if fits is None else fits:
                    seam = end
        configs[0] = seam, 0
        configs = tuple(configs)
        if len(self.states) >= self.most:
            self._clear()
        move = state[b] = self._state(configs), seam
        return move

    def _path(self, seams: list[int], at: int) -> list[int]:
        """The tokens up to a seam, last first."""
        out = []
        while at:
            out.append(seams[at - 1])
            at -= self.length[out[-1]]
        return out

    def _met(self, state: dict, seams: list[int]) -> list[int]:
        """The tokens that the paths of all configurations begin with."""
        paths = [self._path(seams, len(seams) - self.depth[node]) for _, node in state[CONFIGS]]
        n = 0
        while all(len(p) > n and p[-1 - n] == paths[0][-1 - n] for p in paths):
            n += 1
        return paths[0][len(paths[0]) - n :][::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # as the rank files are used: also for a token that no merges make
            return [whole]
        ids, seams, state = [], [], self.start
        for lo in range(0, len(piece), self.window):
            for b in piece[lo : lo + self.window]:
                move = state.get(b)
                if move is None:
                    move = self._move(state, b)
                state, seam = move
                seams.append(seam)
            if lo + self.window < len(piece):
                sure = self._met(state, seams)
                ids += sure
                del seams[: sum(self.length[x] for x in sure)]
        return ids + self._path(seams, len(seams))[::-1]


# ---- UTF-8 as a machine -----------------------------------------------------------------------------------------

def utf8_machine() -> np.ndarray:
    """table[state, byte] is the next state. State 0 is between characters; 1 to 3 wait for so many bytes; 4 to 7 are after the lead
    bytes E0, ED, F0 and F4, whose second byte has a narrower range. A byte that doesn't fit begins anew."""
    table = np.zeros((8, 256), np.uint8)
    table[0, 0xC2:0xE0], table[0, 0xE1:0xF0], table[0, 0xF1:0xF4] = 1, 2, 3
    table[0, [0xE0, 0xED, 0xF0, 0xF4]] = [4, 5, 6, 7]
    table[1:] = table[0]
    table[1, 0x80:0xC0], table[2, 0x80:0xC0], table[3, 0x80:0xC0] = 0, 1, 2
    table[4, 0xA0:0xC0], table[5, 0x80:0xA0], table[6, 0x90:0xC0], table[7, 0x80:0x90] = 1, 1, 2, 2
    return table


class Decoder:
    """`turn[token, state]` is the machine's state after all bytes of a token."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        table, longest = utf8_machine(), max(map(len, ranks))
        self.turn = np.repeat(np.arange(8, dtype=np.uint8)[None, :], size, axis=0)
        lengths = np.array([len(x) for x in self.token])
        padded = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in self.token), np.uint8).reshape(size, longest)
        for k in range(longest):
            has = lengths > k
            self.turn[has] = table[self.turn[has], padded[has, k][:, None]]
        self.known = lengths > 0

    def states(self, ids: np.ndarray, state: int) -> np.ndarray:
        """The state after each token. Tokens that lead from 0 to 0 keep it there; only runs of others are walked one by one."""
        out = self.turn[ids, 0]
        at, n = 0, len(ids)
        odd = np.flatnonzero(out)
        k = 0
        while True:
            if state == 0:
                k += int(np.searchsorted(odd[k:], at))
                if k == len(odd):
                    return out
                at = int(odd[k])
            while at < n:
                out[at] = state = int(self.turn[ids[at], state])
                at += 1
                if state == 0:
                    break
            if at >= n:
                return out

    def decode(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Texts of a stream of blocks of ids, each as soon as its last character is whole."""
        state, held = 0, b""
        for block in ids:
            block = np.asarray(block)
            if len(block) and (block.min() < 0 or block.max() >= len(self.token) or not self.known[block].all()):
                raise ValueError("an id is not of this vocabulary")
            token, after = self.token, self.states(block, state)
            whole = np.flatnonzero(after == 0)
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield (held + b"".join([token[i] for i in block[:cut].tolist()])).decode("utf-8", "replace")
                held = b""
            held += b"".join([token[i] for i in block[cut:].tolist()])
            state = int(after[-1]) if len(after) else state
        if held:
            yield held.decode("utf-8", "replace")


# ---- tables -----------------------------------------------------------------------------------------------------

def parts_of(text: str, most: int = PART) -> Iterator[str]:
    """Parts of about `most` characters. Each but the first begins with white space after something else: no match of the pattern
    holds both, and none looks back."""
    import regex

    seam, at = regex.compile(r"\S(?=\s)"), 0
    while len(text) - at > most:
        m = seam.search(text, at + most)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


class Pieces(dict):
    """Encoded pieces, kept as long as they are no more than MOST_PIECES."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> list[int]:
        ids = self.machine.encode(piece.encode())
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[str, tuple] = {}


def _machines(path: str) -> tuple[Pieces, Decoder]:
    if path not in _LOADED:
        ranks = load_ranks(path)
        _LOADED[path] = Pieces(Transducer(ranks)), Decoder(ranks)
    return _LOADED[path]


def encode_text(text: str, pattern, pieces: Pieces) -> np.ndarray:
    blocks = [list(chain.from_iterable(map(pieces.__getitem__, pattern.findall(part)))) for part in parts_of(text)]
    return np.concatenate([np.array(ids, np.int32) for ids in blocks])


def _encoder(path: str, pattern: str):
    def run(batches):
        import regex

        split = regex.compile(pattern)
        pieces, _ = _machines(path)
        for batch in batches:
            for rows in row_slices(batch, "text"):
                ids = [encode_text(t.as_py() or "", split, pieces) for t in rows.column("text")]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), column], names=["doc_id", "ids"])

    return run


def _decoder(path: str):
    def run(batches):
        _, machine = _machines(path)
        for batch in batches:
            lists = batch.column("ids")
            texts = []
            for i in range(batch.num_rows):
                ids = lists[i].values
                if ids is None:
                    texts.append(None)
                    continue
                ids = ids.to_numpy(zero_copy_only=False)
                texts.append("".join(machine.decode(ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_encoder(path, pattern), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded."""
    small_batches(encoded.sparkSession)
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), f"doc_id {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one pass: doc_id, ids, decoded."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    there, back = _encoder(path, pattern), _decoder(path)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: back(there(batches)), f"doc_id {kind}, ids array<int>, decoded string")


def digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
