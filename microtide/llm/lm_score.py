"""Language-model scores: a unigram word model, and prediction by partial matching over bytes.

The byte model is a trie of contexts of up to ORDER bytes with counts from all training texts. A
symbol unseen in a context escapes to the next shorter one with the probability of method C
(distinct symbols / (total + distinct)), and there the symbols seen in the longer context are
excluded. The trie has no fixed bound, so it stays a table, keyed by context:

1. texts are dealt into parts of about PART_BYTES bytes, in the order they are read;
2. every part gives its distinct words and paths (context and symbol) with their training counts,
   and the nodes that its texts need;
3. these add up to word counts and, over all shorter contexts, to the trie;
4. a part's words and nodes, each once, are joined with them by shuffle (nodes of shorter contexts
   only where they can be escaped to: for texts that weren't learned from);
5. a part's texts meet its own piece of the model and are scored, with arrays for what was seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from microtide.llm.common import materialize, release, table

#: Bytes of context; a path of at most 7 bytes fits a long beside the order.
ORDER = 5
#: Bytes that UTF-8 never has: before a text's first byte, and the symbol after its last.
PAD, END = 0xFE, 0xFF
PART_BYTES, CHUNK = 32 << 20, 1 << 20
#: Paths that are escaped at once.
ROWS = 4096
#: A node is its order in the top byte and its context's bytes below.
TOP = 56


def held_out(doc_id: Column, mod: int = 7, rest: int = 2) -> Column:
    """crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part: the task and how many PART_BYTES of text came before."""
    first, done = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        upto = done + np.cumsum(pc.binary_length(b.column("text").cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        parts = first + np.concatenate([[done], upto[:-1]]) // PART_BYTES if len(upto) else np.zeros(0, np.int64)
        done = int(upto[-1]) if len(upto) else done
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.int64())], [*b.schema.names, "part"])


def _lowered(column) -> list[bytes]:
    return [t.lower() for t in column.cast(pa.binary()).to_pylist()]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    at = 0
    while at < len(texts):
        upto, size = at + 1, len(texts[at])
        while upto < len(texts) and size + len(texts[upto]) <= CHUNK:
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _paths(texts: list[bytes], order: int) -> np.ndarray:
    """Per place the context and symbol in one long; places between texts end in PAD."""
    s = b"".join([bytes((PAD,)) * order + t + bytes((END,)) for t in texts]) + bytes(8)
    # Eight bytes from every place on, of which the first order + 1 are the path.
    eight = np.ndarray((len(s) - 8 - order,), ">u8", s, strides=(1,))
    return (eight.astype(np.uint64) >> np.uint64(8 * (7 - order))).astype(np.int64)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several sorted lists, in order, with the sums of their counts."""
    k = np.unique(np.concatenate(keys))
    total = np.zeros(len(k), np.int64)
    for some, c in zip(keys, counts, strict=True):
        total[np.searchsorted(k, some)] += c
    return k, total


class Places:
    """Where distinct integers stand, by open addressing: a lookup is a few array reads, whatever their number."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, math.ceil(math.log2(max(1, len(keys)) * 2.5)))
        self.last = (1 << self.bits) - 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, left = self._start(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            open_ = left[self.slots[at[left]] < 0]
            self.slots[at[open_]] = open_
            left = left[self.slots[at[left]] != left]
            at[left] = at[left] + 1 & self.last

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._start(keys)
        out = self.slots[at]
        other = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        while len(other):
            at[other] = at[other] + 1 & self.last
            out[other] = self.slots[at[other]]
            other = other[(self.keys[out[other]] != keys[other]) & (out[other] >= 0)]
        return out


def _seen(order: int) -> object:
    """Per part its distinct training paths with their counts, its words with theirs, and the nodes it needs; each row has one of the three."""
    schema = pa.schema([("part", pa.int64()), ("path", pa.int64()), ("word", pa.binary()), ("node", pa.int64()), ("c", pa.int64())])

    def of_part(part, n, **columns) -> pa.RecordBatch:
        return pa.record_batch([np.full(n, part), *[columns.get(f.name, pa.nulls(n, f.type)) for f in list(schema)[1:]]], schema=schema)

    def rows(part, of: dict[bool, list]) -> Iterator[pa.RecordBatch]:
        words: dict[bool, Counter] = {}
        paths = {}
        for learn, texts in of.items():
            words[learn] = Counter()
            for t in texts:
                words[learn].update(t.split())
            words[learn][b""] = len(texts)
            keys, counts = [], []
            for a, b in _chunks(texts):
                k, c = np.unique(_paths(texts[a:b], order), return_counts=True)
                keys.append(k[(k & 255) != PAD])
                counts.append(c[(k & 255) != PAD])
            paths[learn] = _added(keys, counts)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        learned, other = paths.get(True, none), paths.get(False, none)
        yield of_part(part, len(learned[0]), path=learned[0], c=learned[1])
        nodes = [np.unique(np.concatenate([learned[0], other[0]]) >> 8) | order << TOP]
        nodes += [np.unique(other[0] >> 8 & ((1 << 8 * k) - 1)) | k << TOP for k in range(order)]
        for n in nodes:
            yield of_part(part, len(n), node=n)
        known = words.get(True, Counter())
        all_words = list(known.keys() | words.get(False, Counter()).keys())
        yield of_part(part, len(all_words), word=pa.array(all_words, pa.binary()), c=np.array([known.get(w, 0) for w in all_words], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, {}
        for b in batches:
            for part, learn, text in zip(b.column("part").to_pylist(), b.column("learn").to_pylist(), _lowered(b.column("text")), strict=True):
                if part != now and of:
                    yield from rows(now, of)
                    of = {}
                now = part
                of.setdefault(learn, []).append(text)
        if of:
            yield from rows(now, of)

    return run


def trie(paths: DataFrame, order: int) -> DataFrame:
    """(node, next) from (path, c) of the longest contexts: next has count * 256 + symbol per symbol seen in that context or a longer one of it."""
    mask = lambda k: F.lit((1 << 8 * (k + 1)) - 1)
    each = F.explode(F.array(*[F.struct(F.lit(k << TOP).alias("top"), F.col("path").bitwiseAND(mask(k)).alias("p")) for k in range(order + 1)]))
    added = paths.select(each.alias("e"), "c").groupBy("e.top", "e.p").agg(F.sum("c").alias("c"))
    # At most 256 symbols a node.
    node = F.col("top").bitwiseOR(F.shiftright("p", 8)).alias("node")
    return added.select(node, (F.col("c") * 256 + F.col("p").bitwiseAND(F.lit(255))).alias("n")).groupBy("node").agg(F.sort_array(F.collect_list("n")).alias("next"))


class Model:
    """A part's piece of the trie: its nodes, and their symbols and counts one after another."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, packed: np.ndarray, order: int):
        ends = np.cumsum(sizes)
        self.order, self.of_node = order, Places(nodes)
        self.spans = np.stack([ends - sizes, ends], 1)
        self.symbols, self.counts = packed & 255, packed >> 8
        # Paths of the longest contexts, with their probabilities.
        of = np.repeat(np.arange(len(nodes)), sizes)
        total = np.bincount(of, self.counts, len(nodes)) + sizes
        long = (nodes >> TOP)[of] == order
        keys = ((nodes[of] & ((1 << TOP) - 1)) << 8 | self.symbols)[long]
        self.places, self.log_p = Places(keys), np.log10(self.counts[long] / total[of[long]])

    def _escape(self, paths: np.ndarray) -> np.ndarray:
        """log10 P of symbols that their longest contexts haven't seen, by escapes and exclusion."""
        n = len(paths)
        symbol, context = paths & 255, paths >> 8
        p, out, barred, live = np.ones(n), np.zeros(n), np.zeros((n, 256), bool), np.ones(n, bool)
        for k in range(self.order, -1, -1):
            at = self.of_node.find(k << TOP | context & ((1 << 8 * k) - 1))
            rows = np.flatnonzero(live & (at >= 0))
            first, sizes = self.spans[at[rows], 0], self.spans[at[rows], 1] - self.spans[at[rows], 0]
            # All symbols of these rows' nodes, one after another.
            row = np.repeat(rows, sizes)
            flat = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
            open_ = ~barred[row, self.symbols[flat]]
            row, flat = row[open_], flat[open_]
            s, c = self.symbols[flat], self.counts[flat]
            kinds = np.bincount(row, minlength=n)
            whole = np.bincount(row, c, n) + kinds
            hit = s == symbol[row]
            out[row[hit]] = np.log10(p[row[hit]] * c[hit] / whole[row[hit]])
            live[row[hit]] = False
            some = kinds > 0
            p[some] *= kinds[some] / whole[some]
            barred[row, s] = True
        out[live] = np.log10(p[live] / (256 - barred[live].sum(1)))
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        """log10 probability of every text with its end."""
        out: list[float] = []
        for a, b in _chunks(texts):
            paths = _paths(texts[a:b], self.order)
            at = self.places.find(paths)
            got = self.log_p[at] if len(self.log_p) else np.zeros(len(paths))
            got[at < 0] = 0.0
            missed = np.flatnonzero((at < 0) & ((paths & 255) != PAD))
            if len(missed):
                keys, which = np.unique(paths[missed], return_inverse=True)
                got[missed] = np.concatenate([self._escape(keys[i : i + ROWS]) for i in range(0, len(keys), ROWS)])[which]
            got[(paths & 255) == PAD] = 0
            # A text has len + 1 places, those up to the next one's first end in PAD.
            sizes = np.array([len(t) + 1 + self.order for t in texts[a:b]])
            sums = np.concatenate([[0.0], np.cumsum(got)])
            ends = np.cumsum(sizes)
            out += (sums[np.minimum(ends, len(got))] - sums[ends - sizes]).tolist()
        return out


def adaptive_score(text: bytes, order: int = 2) -> float:
    """log10 probability of a text by a model that starts empty and learns each symbol after coding it."""
    trie: dict[bytes, dict[int, int]] = {}
    total, past = 0.0, bytes((PAD,)) * order
    for symbol in [*text, END]:
        p, barred = 1.0, set()
        for k in range(order, -1, -1):
            seen = {s: c for s, c in trie.get(past[len(past) - k :] if k else b"", {}).items() if s not in barred}
            whole = sum(seen.values()) + len(seen)
            if symbol in seen:
                p *= seen[symbol] / whole
                break
            if seen:
                p *= len(seen) / whole
                barred |= set(seen)
        else:
            p /= 256 - len(barred)
        total += math.log10(p)
        for k in range(order + 1):
            node = trie.setdefault(past[len(past) - k :] if k else b"", {})
            node[symbol] = node.get(symbol, 0) + 1
        past = (past + bytes((symbol,)))[-order:] if order else b""
    return total


def _scored(n: int, v: int, order: int, mode: str, fields: pa.Schema) -> object:
    def run(texts: pa.Table, model: pa.Table) -> pa.Table:
        words = model.filter(pc.is_valid(model.column("word"))).combine_chunks()
        count = dict(zip(words.column("word").to_pylist(), words.column("c").to_pylist(), strict=True))
        lowered = _lowered(texts.column("text"))
        n_tokens, n_known, base = [], [], []
        for t in lowered:
            c = np.array([count.get(w, 0) for w in (*t.split(), b"")], np.int64)
            n_tokens.append(len(c))
            n_known.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 1.0).sum() - len(c) * math.log10(n + v + 1)))
        if mode == "adaptive":
            scores = [adaptive_score(t, order) for t in lowered]
        else:
            nodes = model.filter(pc.is_valid(model.column("node"))).combine_chunks()
            lists = nodes.column("next")
            flat = pc.list_flatten(lists)
            sizes = pc.list_value_length(lists)
            number = lambda x: x.to_numpy().astype(np.int64)
            scores = Model(number(nodes.column("node")), number(sizes), number(flat), order).scores(lowered)
        ids = texts.column("doc_id")
        return pa.table([ids, texts.column("held_out"), n_tokens, n_known, [n] * len(ids), base, scores], schema=fields)

    return run


def score(docs: DataFrame, train: Column | None = None, mode: str = "pretrained", order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``train`` holds (default: not held_out). A-Z are lower-cased.
    Null text is the empty one: one end token. Without training texts all symbols are equally
    likely. Repeated rows are scored each; an empty table gives no rows. mode "adaptive" codes
    each text by itself, learning as it goes.
    """
    held = held_out(F.col("doc_id"))
    learn = F.coalesce(~held if train is None else train, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), learn.alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = materialize(rows.mapInArrow(_dealt, f"doc_id {kind}, held_out boolean, learn boolean, text string, part long"))
    seen = materialize(texts.select("part", "learn", "text").mapInArrow(_seen(order), "part long, path long, word binary, node long, c long"))
    words = materialize(seen.where("word is not null and c > 0").groupBy("word").agg(F.sum("c").alias("c")))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    asked = seen.where("word is not null").select("part", "word").join(words, "word").select("part", "word", "c", F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<long>").alias("next"))
    if mode != "adaptive":
        made = materialize(trie(seen.where("path is not null").groupBy("path").agg(F.sum("c").alias("c")), order))
        needs = seen.where("node is not null").select("part", "node")
        asked = asked.unionByName(needs.join(made, "node").select("part", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"), "node", "next"))
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    fields = pa.schema([(texts.schema["doc_id"].name, to_arrow_type(rows.schema["doc_id"].dataType)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    groups = texts.select("part", "doc_id", "held_out", "text").groupBy("part").cogroup(asked.groupBy("part"))
    done = materialize(groups.applyInArrow(_scored(total["n"], total["v"], order, mode, fields), out))
    release(texts, seen, words, *([made] if mode != "adaptive" else []))
    return done


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
