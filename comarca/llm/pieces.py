"""SentencePiece encoding and decoding over a relational lattice.

Distinct words are exploded into their substrings of bounded length, which an equi-join with the piece table turns into
lattice edges; edges are grouped by word and folded with Spark's ``aggregate``. The fold depends on the kind of model:
for a unigram model it is Viterbi's best sum of scores; for a BPE model, where the best sum is not what the model
means, edges are taken best score first and merged where exactly one cut lies inside (``fold_merges``).

Texts are cut wherever no piece holds the two neighbouring characters side by side, so no piece reaches over a border
and the words between borders can be encoded apart from each other. They are told apart by 64-bit hashes. Words seen at
least twice form a dictionary of bounded size, which is broadcast; the others pass through the same lattice, keyed by
their document, and those too long for it are merged where their document is put together.
"""

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from comarca.llm.frames import with_text
from comarca.llm.words import _power, mix, slices
from comarca.session import durable

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DICTIONARY = 2_000_000  # words in the broadcast dictionary, about 40 bytes each
FOLDED = 60  # longer words are merged with a heap, since a fold keeps their cuts in one 64-bit number
SPACE = "▁"


class Pieces:
    """The piece table of a model file: text, id and score of each piece, ids of bytes and of the unknown piece."""

    def __init__(self, path=MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        if any(not model.is_byte(i) for i in self.bytes) or self.bytes != list(range(self.bytes[0], self.bytes[0] + 256)):
            raise ValueError("a model with 256 consecutive byte pieces is needed")
        self.rows = [
            (model.id_to_piece(i), i, float(model.get_score(i)))
            for i in every
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.longest = max(len(p) for p, _, _ in self.rows)
        # the bytes that each id stands for
        texts = [b""] * len(every)
        for p, i, _ in self.rows:
            texts[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            texts[i] = bytes([b])
        self.sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        # joined[256 * a + b]: some piece has a character ending in byte a before one beginning with byte b
        self.joined = np.zeros(1 << 16, bool)
        for p, _, _ in self.rows:
            letters = [c.encode() for c in p.replace(SPACE, " ")]
            for a, b in zip(letters, letters[1:]):
                self.joined[256 * a[-1] + b[0]] = True

    def table(self, spark):
        """``piece, id, score, opens``; ``opens`` where a piece of better score begins or ends with this one."""
        scores = {p: score for p, _, score in self.rows}
        opens = set()
        for p, score in scores.items():
            parts = [part for k in range(1, len(p)) for part in (p[:k], p[k:])]
            opens.update(part for part in parts if scores.get(part, score) < score)
        rows = [(*row, row[0] in opens) for row in self.rows]
        return spark.createDataFrame(rows, "piece string, id int, score double, opens boolean")


# --- words as byte ranges -----------------------------------------------------------------------------------------


def spaced(texts):
    """Texts with a leading space each, as the model wants them; empty ones stay empty."""
    return ["" if not t else " " + t.replace(SPACE, " ") for t in texts]


class Chunks:
    """Words of a slice of spaced texts: starts, ends, hashes, and the first word of each text."""

    def __init__(self, data, offsets, joined):
        start = np.ones(len(data), bool)
        pair = data[:-1].astype(np.int32) << 8 | data[1:]
        start[1:] = ~joined[pair] & (data[1:] & 0xC0 != 0x80)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        self.data, self.starts = data, np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], len(data)) if len(data) else self.starts
        self.first = np.searchsorted(self.starts, offsets)
        sizes = self.ends - self.starts
        if len(sizes):
            place = np.arange(len(data)) - np.repeat(self.starts, sizes)
            terms = _power(int(sizes.max()))[place] * (data.astype(np.uint64) + np.uint64(1))
            self.hashes = mix(np.add.reduceat(terms, self.starts) ^ (sizes.astype(np.uint64) << np.uint64(40)))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def texts(self, at):
        """The words at the given places."""
        bounds = np.append(self.starts, len(self.data)).astype(np.int32)
        every = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(bounds), pa.py_buffer(self.data))
        return every.take(pa.array(at))


def _spaced_slices(column, size=1 << 19):
    for row, data, offsets in slices(column, size):
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
        for _, more, bounds in slices(pa.array(spaced(texts), pa.large_string()), 1 << 62):
            yield row, texts, more, bounds


def count_words(texts: DataFrame, joined) -> DataFrame:
    """``word, n`` of all words of ``texts(text)``."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in _spaced_slices(batch.column("text")):
                chunks = Chunks(data, offsets, joined)
                _, at, n = np.unique(chunks.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([chunks.texts(at), pa.array(n)], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_hash(counts: DataFrame) -> DataFrame:
    """``h, word, n``: words that are not empty with their hashes, which do not compress and so are left out of shuffles."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for _, data, offsets in slices(batch.column("word"), 1 << 62):
                    sizes = np.diff(offsets)
                    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
                    terms = _power(int(sizes.max()))[place] * (data.astype(np.uint64) + np.uint64(1))
                    hashes = mix(np.add.reduceat(terms, offsets[:-1]) ^ (sizes.astype(np.uint64) << np.uint64(40)))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *batch.columns], ["h", "word", "n"])

    return counts.mapInArrow(run, "h long, word string, n long")


# --- the lattice --------------------------------------------------------------------------------------------------


def lattice(words: DataFrame, keys, pieces: DataFrame, longest) -> DataFrame:
    """``keys``, ``size`` and ``edges`` (rank, start, length, id; best rank first) of every word of ``words``.

    Single characters have an edge each; where they are no piece, its id is -1 minus their code point. ``pieces`` is the
    vocabulary, so its size is bounded; without its column ``opens`` all pieces are taken to open others. ``words(keys, word)`` must be distinct by ``keys``, none empty, and dealt by
    some of ``keys``.
    """
    text = F.regexp_replace("word", " ", SPACE)
    cut = words.select(*keys, text.alias("_text")).withColumn("_size", F.length("_text"))
    starts = cut.withColumn("s", F.explode(F.expr("sequence(0, _size - 1)")))
    spans = starts.withColumn("n", F.explode(F.expr(f"sequence(1, least({int(longest)}, _size - s))")))
    parts = spans.select(*keys, "s", "n", F.expr("substring(_text, s + 1, n)").alias("piece"))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where("id is not null or n = 1")
    rank, own = F.coalesce(-F.col("score"), F.lit(0.0)).cast("float"), F.coalesce("id", -1 - F.ascii("piece"))
    opens = F.coalesce("opens", F.lit(False)) if "opens" in pieces.columns else F.lit(True)
    edge = F.struct(rank.alias("r"), "s", "n", own.alias("id"), opens.alias("opens"))
    grouped = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    return grouped.withColumn("size", F.expr("aggregate(edges, 0, (a, e) -> greatest(a, e.s + e.n))"))


# An edge can be merged where both of its ends are cuts and exactly one cut lies inside.
_INSIDE = "(shiftleft(1L, {e}.s + {e}.n) - shiftleft(2L, {e}.s))"
_FITS = (
    "({m} & shiftleft(1L, {e}.s)) != 0 and ({m} & shiftleft(1L, {e}.s + {e}.n)) != 0 and bit_count({m} & " + _INSIDE + ") = 1"
)


def _fold_fast():
    """One pass over edges by rank; ``late`` tells that a merge opened an edge of better rank, so one pass is not enough."""
    merged = "(a.m & ~" + _INSIDE.format(e="e") + ")"
    opened = "exists(longer, p -> (p.s = e.s or p.s + p.n = e.s + e.n) and p.r < e.r and " + _FITS.format(m=merged, e="p") + ")"
    step = f"if({_FITS.format(m='a.m', e='e')}, named_struct('m', {merged}, 'late', a.late or (e.opens and {opened})), a)"
    return f"aggregate(longer, named_struct('m', shiftleft(1L, size + 1) - 1, 'late', false), (a, e) -> {step})"


def _fold_exact():
    """As many steps as there can be merges, each taking the best edge that fits."""
    best = "filter(longer, e -> " + _FITS.format(m="m", e="e") + ")[0]"
    step = f"coalesce(m & ~{_INSIDE.format(e=best)}, m)"
    return f"aggregate(sequence(2, size), shiftleft(1L, size + 1) - 1, (m, k) -> {step})"


def fold_merges(words: DataFrame) -> DataFrame:
    """Add ``mask`` and ``cuts``: the starts of a word's pieces, as bits and listed, by BPE merges over ``size, edges``."""
    out = words.withColumn("longer", F.expr("filter(edges, e -> e.n > 1)")).withColumn("_fast", F.expr(_fold_fast()))
    mask = F.when(F.col("_fast.late"), F.expr(_fold_exact())).otherwise(F.col("_fast.m"))
    out = out.withColumn("mask", mask)
    cuts = F.expr("filter(sequence(0, size - 1), i -> (mask & shiftleft(1L, i)) != 0)")
    return out.withColumn("cuts", cuts).drop("longer", "_fast")


def fold_viterbi(words: DataFrame, unknown=-1e4) -> DataFrame:
    """Add ``mask`` and ``cuts`` of the largest sum of scores over ``size, edges``; ties go to the longer last piece.

    Characters that are no piece cost ``unknown``. The state is the best score and start of the last piece, by end.
    """
    gain = f"if(e.id < 0, {unknown}D, -e.r)"
    reach = f"transform(filter(edges, e -> e.s + e.n = k), e -> struct(best[e.s].v + {gain} as v, -e.s as s))"
    start = "array(named_struct('v', 0D, 's', 0))"
    best = f"aggregate(sequence(1, size), {start}, (best, k) -> concat(best, array(array_max({reach}))))"
    back = """aggregate(sequence(1, size), named_struct('p', size, 'c', cast(array() as array<int>)),
        (a, k) -> if(a.p = 0, a, named_struct('p', -_best[a.p].s, 'c', concat(array(-_best[a.p].s), a.c)))).c"""
    mask = "aggregate(cuts, shiftleft(1L, size), (m, i) -> m | shiftleft(1L, i))"
    found = words.withColumn("_best", F.expr(best)).withColumn("cuts", F.expr(back)).drop("_best")
    return found.withColumn("mask", F.expr(mask))


#: An edge is a piece of the result where both of its ends are cuts and no cut lies inside.
_CHOSEN = (
    "(mask & shiftleft(1L, e.s)) != 0 and (mask & shiftleft(1L, e.s + e.n)) != 0 and (mask & " + _INSIDE.format(e="e") + ") = 0"
)


def ids_of(folded: DataFrame, keys, first_byte) -> DataFrame:
    """``keys, ids`` of folded words; characters that are no piece become the ids of their UTF-8 bytes."""
    tail = [f"{first_byte + 128} + (shiftright(-1 - c.id, {6 * k}) & 63)" for k in range(3)]
    octets = f"""case when c.id >= -128 then array({first_byte - 1} - c.id)
        when c.id >= -2048 then array({first_byte + 192} + shiftright(-1 - c.id, 6), {tail[0]})
        when c.id >= -65536 then array({first_byte + 224} + shiftright(-1 - c.id, 12), {tail[1]}, {tail[0]})
        else array({first_byte + 240} + shiftright(-1 - c.id, 18), {tail[2]}, {tail[1]}, {tail[0]}) end"""
    chosen = f"sort_array(transform(filter(edges, e -> {_CHOSEN}), e -> struct(e.s as s, e.id as id)))"
    ids = f"""if(exists(_chosen, c -> c.id < 0), flatten(transform(_chosen, c -> if(c.id < 0, {octets}, array(c.id)))),
        transform(_chosen, c -> c.id))"""
    return folded.withColumn("_chosen", F.expr(chosen)).select(*keys, F.expr(ids).alias("ids"))


def merge_long(word: str, ranks: dict, first_byte: int) -> list[int]:
    """BPE of one long word with a heap: n log n steps. ``ranks`` has (score, id) of each piece."""
    parts, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < len(parts):
            found = ranks.get(parts[i] + parts[j])
            if found:
                heapq.heappush(heap, (-found[0], i, parts[i], parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = a + b, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out = []
    for p in parts:
        if p is not None:
            out += [ranks[p][1]] if p in ranks else [first_byte + b for b in p.encode()]
    return out


def encode_short(words: DataFrame, keys, model: Pieces) -> DataFrame:
    """``keys, ids`` of ``words(keys, word)`` of at most ``FOLDED`` characters that are distinct by ``keys``."""
    edges = lattice(words, keys, model.table(words.sparkSession), model.longest)
    return ids_of(fold_merges(edges), keys, model.bytes[0])


def encode_words(words: DataFrame, keys, model: Pieces) -> DataFrame:
    """``keys, ids`` of ``words(keys, word)`` that are distinct by ``keys``."""
    first_byte = model.bytes[0]
    folded = encode_short(words.where(F.length("word") <= FOLDED), keys, model)
    ranks = {p: (s, i) for p, i, s in model.rows}

    def long(batches):
        for batch in batches:
            found = [merge_long(w.as_py().replace(" ", SPACE), ranks, first_byte) for w in batch.column("word")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(found, pa.list_(pa.int32()))], [*keys, "ids"]
            )

    types = dict(words.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", ids array<int>"
    return folded.unionByName(words.where(F.length("word") > FOLDED).select(*keys, "word").mapInArrow(long, schema))


# --- documents ----------------------------------------------------------------------------------------------------


def _dictionary(counts: DataFrame, model, most):
    """Sorted word hashes, offsets and ids of at most ``most`` words: those of the largest counts, whole counts only."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r[0]: r[1] for r in counts.groupBy(level.alias("l")).count().collect()}  # at most 8 rows a doubling
    total, least = 0, None
    for key in sorted(sizes, reverse=True):
        total += sizes[key]
        if total > most:
            break
        least = key
    words = counts.where(level >= least) if least is not None else counts.limit(0)
    pieces = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = with_hash(words).select("h", "word").repartition(pieces, "h")
    table = encode_words(keyed, ["h"], model).toArrow().combine_chunks()
    hashes = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    ids = table.column("ids").combine_chunks().take(pa.array(order))
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    kind = np.uint16 if len(model.sizes) <= 1 << 16 else np.uint32
    bounds = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return hashes[order], bounds, ids.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _look_up(hashes, known):
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    return at, known[at] == hashes if len(known) else np.zeros(len(hashes), bool)


def encode(documents: DataFrame, path=MODEL, dictionary=DICTIONARY, carry=()) -> DataFrame:
    """``doc_id, n_words, n_tokens, ids, round_trip`` and the columns ``carry`` of every row of ``documents(doc_id, text)``.

    ``n_words`` counts runs without spaces (U+0020). Ids are those of the model for the whole text. ``round_trip`` tells that they decode to the text, U+2581 counting as
    a space. Null and empty texts have no ids. Rows that repeat an id are encoded each. Rows equal in id and text share
    their rare words, which changes nothing.
    """
    spark = documents.sparkSession
    context, pieces = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    model = Pieces(path)
    texts = with_text(documents, "doc_id", "text", *carry)
    counts = durable(count_words(texts, model.joined).where("n > 1"))
    # at most ``dictionary`` words
    shared = context.broadcast((*_dictionary(counts, model, dictionary), model.joined, model.sizes, model.starts, model.flat))

    key = F.xxhash64("doc_id", "text").alias("_key")
    keyed = texts.select(key, "doc_id", "text", *[F.col(f"`{c}`").alias(f"_{c}") for c in carry])

    def rare(batches):
        known, joined = shared.value[0], shared.value[3]
        for batch in batches:
            for row, _, data, offsets in _spaced_slices(batch.column("text")):
                chunks = Chunks(data, offsets, joined)
                missing = np.flatnonzero(~_look_up(chunks.hashes, known)[1])
                owner = np.searchsorted(chunks.first, missing, "right") - 1
                # each word of a text once
                order = np.lexsort((chunks.hashes[missing], owner))
                missing, owner = missing[order], owner[order]
                new = np.ones(len(missing), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (chunks.hashes[missing[1:]] != chunks.hashes[missing[:-1]])
                words = chunks.texts(missing[new])
                short = pc.less_equal(pc.utf8_length(words), FOLDED)
                hashes = pa.array(chunks.hashes[missing[new]].view(np.int64))
                keys = batch.column("_key").slice(row).take(pa.array(owner[new]))
                yield pa.RecordBatch.from_arrays([keys, hashes, words], ["_key", "h", "word"]).filter(short)

    # dealt by document once: neither the lattice nor what follows shuffles again
    found = keyed.select("_key", "text").mapInArrow(rare, "_key long, h long, word string").repartition(pieces, "_key")
    encoded = encode_short(found.distinct(), ["_key", "h"], model)
    own = encoded.groupBy("_key").agg(F.collect_list(F.struct("h", "ids")).alias("rare"))
    joined = keyed.join(own, "_key", "left")
    ranks = {p: (s, i) for p, i, s in model.rows}
    first_byte = model.bytes[0]

    def assemble(batches):
        known, bounds, flat, joined, sizes, starts, letters = shared.value
        for batch in batches:
            others = batch.column("rare")
            for row, texts, data, offsets in _spaced_slices(batch.column("text")):
                chunks = Chunks(data, offsets, joined)
                at, held = _look_up(chunks.hashes, known)
                begin = np.zeros(len(at), np.int64)
                count = np.zeros(len(at), np.int64)
                begin[held], count[held] = bounds[at[held]], bounds[at[held] + 1] - bounds[at[held]]
                extra, end, own, last = [], len(flat), None, -1
                missing, signed = np.flatnonzero(~held), chunks.hashes.view(np.int64)
                long = {}  # the words that no lattice takes
                for i, t in zip(missing, np.searchsorted(chunks.first, missing, "right") - 1):
                    if t != last:
                        own, last = {x["h"]: x["ids"] for x in others[row + t].as_py() or ()}, t
                    ids = own.get(signed[i]) or long.get(signed[i])
                    if ids is None:
                        word = data[chunks.starts[i] : chunks.ends[i]].tobytes().decode()
                        if len(word) <= FOLDED:
                            raise KeyError(f"the lattice has lost {word!r}")
                        ids = long[signed[i]] = merge_long(word.replace(" ", SPACE), ranks, first_byte)
                    begin[i], count[i] = end, len(ids)
                    extra += ids
                    end += len(ids)
                pool = np.concatenate((flat, np.array(extra, flat.dtype))) if extra else flat
                ids = pool[_ranges(begin, count)].astype(np.int32)
                tokens = np.concatenate(([0], np.cumsum(count)))[chunks.first]
                back = letters[_ranges(starts[ids], sizes[ids])]
                ends = np.concatenate(([0], np.cumsum(sizes[ids])))[tokens]
                same = len(back) == len(data) and (back == data)
                wrong = np.concatenate(([0], np.cumsum(~same))) if len(back) == len(data) else None
                fine = [
                    (e - s == y - x) and (wrong is not None and s == x and wrong[e] == wrong[s] or bool(np.array_equal(back[s:e], data[x:y])))
                    for s, e, x, y in zip(ends, ends[1:], offsets, offsets[1:])
                ]
                rows = len(texts)
                begins = np.zeros(len(data) + 1, np.int64)
                begins[2:] = np.cumsum((data[1:] != 32) & (data[:-1] == 32)) if len(data) else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, rows), pa.array(np.diff(begins[offsets]), pa.int64()),
                        pa.array(np.diff(tokens), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(ids)), pa.array(fine, pa.bool_()),
                        *(batch.column(f"_{c}").slice(row, rows) for c in carry),
                    ],
                    [*made, *carry],
                )

    made = ["doc_id", "n_words", "n_tokens", "ids", "round_trip"]
    schema = "doc_id long, n_words long, n_tokens long, ids array<int>, round_trip boolean"
    schema += "".join(f", `{c}` {texts.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(assemble, schema)


def _ranges(begin, count):
    """Indices of all the ranges, one behind the other."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - count), count)


def decode(encoded: DataFrame, path=MODEL) -> DataFrame:
    """All columns of ``encoded(ids)`` and ``decoded``: the text of the ids; null ids give a null text.

    Control and unknown ids stand for nothing, ids outside of the vocabulary are an error; bytes that are no UTF-8 become U+FFFD.
    """
    model = Pieces(path)
    texts = [model.flat[s : s + n].tobytes() for s, n in zip(model.starts, model.sizes)]
    names = encoded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(names.index("ids")).to_pylist():
                if x is not None and any(not 0 <= i < len(texts) for i in x):
                    raise ValueError("an id is outside of the vocabulary")
                out.append(None if x is None else b"".join(texts[i] for i in x).decode("utf-8", "replace").removeprefix(" "))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)
