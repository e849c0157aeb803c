"""SimHash near-duplicates through an inverted index of positional bytes with count filtering.

Two 64-bit fingerprints that differ in at most ``radius`` bits share at least 8 - radius of their
eight positional bytes.  Lists of single bytes hold a 256th of all fingerprints each, so tallying
over them would pair up the whole table; the index here is keyed on combinations of positional
bytes instead: sets of three positions of which every choice of four shared positions contains one.
Every pair that can pass the count filter meets in at least one list; there its shared positional
bytes are tallied, pairs under the minimum are dropped, and the others are verified bit by bit.

Wider fingerprints serve similarities as low as 0.8 of word shingles, where 15 % of the bits differ and
no number of shared bytes is certain.  Positions lie in groups of eight, and lists are keyed on the pairs
within a group: every choice of one position more than there are groups contains such a pair, and that
number is the minimum of shared bytes.  Of 192 bits, pairs of similarity 0.8 share four of 24 bytes with a
probability of 0.92, closer ones nearly always.  Lists are then joined by their nearest links, and each of
these is verified by the similarity of the two texts' shingles.  Where one fails, what it joined is searched
anew for all other links between what is not joined yet, so that no link is lost that the filters let pass.
Short texts are compared by the sketches that all links carry (``SKETCH``), longer ones by their whole sets.

Equal fingerprints are one entry of the index, however many documents carry them.  A list that is
longer than a bound is keyed anew with a further shared position, and what is still too long is dealt
into blocks that meet pairwise, so no task holds an unbounded list.  A list passes on a spanning
forest of its links, which keeps every link's effect on the components.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows are
members of one component; documents without id count in no minimum; a long text is read whole, in
stretches; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import filled, let_go, materialise, text_slices
from cellframe.llm.components import connected_components

#: Fixed value: the seed of the shingles' hash.
SEED = 42
#: Characters of a long text that are split into words at once.
STRETCH = 1 << 20
#: Fingerprints of one list that one task compares.
LIST_BOUND = 1024
#: Length of lists that are compared many at a time, and up to which one list is compared at once.
SHORT, AT_ONCE = 8, 256
#: Keys over which the documents of one fingerprint are dealt.
SALTS = 64
#: Bits in which fingerprints of 192 bits may differ where five-word shingles have a similarity of 0.8: two deviations above the mean.
SIMILAR = 40
#: Shingles' hashes that links carry; pairs of which a text has as many or more are compared by whole sets.
SKETCH = 1024
#: Links that a list gives at first between two groups of members that a failed link left apart.
BETWEEN = 64


def word_stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text`` in stretches of bounded size."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: str, shingle: int = 4, width: int = 1) -> tuple[int, ...]:
    """The SimHash of the word shingles' hashes, repeats included, as ``width`` 64-bit integers; zero without words.

    One integer is made of XXH64, two of the 128 bits of XXH3, three of both.
    """
    ones, total, held = np.zeros(64 * width, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest if width == 1 else xxhash.xxh3_128_digest

    def hashes(runs) -> np.ndarray:
        if width == 1:
            return np.array([digest(r, SEED) for r in runs], dtype="<u8").view(np.uint8).reshape(-1, 8)
        if width == 3:
            return np.frombuffer(b"".join([digest(r, SEED) + xxhash.xxh64_digest(r, SEED) for r in runs]), dtype=np.uint8).reshape(-1, 24)
        return np.frombuffer(b"".join([digest(r, SEED) for r in runs]), dtype=np.uint8).reshape(-1, 16)

    for words in word_stretches(text.encode().lower()):
        held += words
        if len(held) < shingle:
            continue
        found = hashes(map(b" ".join, zip(*(held[i:] for i in range(shingle)), strict=False)))
        for at in range(0, len(found), 1 << 16):
            ones += np.unpackbits(found[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(found)
        held = held[len(held) - shingle + 1 :]
    if not total:
        if not held:
            return (0,) * width
        ones, total = np.unpackbits(hashes([b" ".join(held)]), axis=1, bitorder="little")[0].astype(np.int64), 1
    return tuple(np.packbits(ones * 2 > total, bitorder="little").view("<u8").tolist())


def sketch(text: str, shingle: int = 5, size: int = SKETCH) -> np.ndarray:
    """The ``size`` smallest distinct 32-bit hashes of the word shingles, in order; none without words."""
    least, held, some = np.zeros(0, dtype=np.uint32), [], False
    for words in word_stretches(text.encode().lower()):
        held += words
        if len(held) < shingle:
            continue
        runs = map(b" ".join, zip(*(held[i:] for i in range(shingle)), strict=False))
        least = np.unique(np.concatenate([least, np.array([xxhash.xxh32_intdigest(r, SEED) for r in runs], dtype=np.uint32)]))[:size]
        held, some = held[len(held) - shingle + 1 :], True
    if held and not some:
        return np.array([xxhash.xxh32_intdigest(b" ".join(held), SEED)], dtype=np.uint32)
    return least


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles, in order; none without words."""
    whole, held, some = np.zeros(0, dtype=np.uint64), [], False
    for words in word_stretches(text.encode().lower()):
        held += words
        if len(held) < shingle:
            continue
        runs = map(b" ".join, zip(*(held[i:] for i in range(shingle)), strict=False))
        whole = np.unique(np.concatenate([whole, np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], dtype=np.uint64)]))
        held, some = held[len(held) - shingle + 1 :], True
    if held and not some:
        return np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)
    return whole


def similarity_of(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard similarity of two sets by their sketches: exact where the union is within ``size``, of its smallest hashes beyond."""
    union, both = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((both[:size] == 2).mean()) if len(union) else 1.0


def names(width: int) -> list[str]:
    """The columns of a fingerprint."""
    return [f"fp{i}" for i in range(width)]


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 1, text: str = "text") -> DataFrame:
    """``docs`` without its text's column, with the fingerprint as signed 64-bit integers."""
    others = [c for c in docs.columns if c != text]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch, len(others)):
                part = batch.slice(a, b - a)
                found = np.array([fingerprint(t, shingle, width) for t in filled(part.column(len(others))).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], *(pa.array(found[:, i]) for i in range(width))], [*others, *names(width)])
        let_go()

    schema = docs.select(*others).schema
    for name in names(width):
        schema = schema.add(name, "long")
    return docs.select(*others, text).mapInArrow(hashed, schema)


def covering_triples() -> list[tuple[int, ...]]:
    """Twenty sets of three of eight byte positions of which every four positions contain one."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(triple: tuple[int, int, int]) -> bool:
        tally = [sum(part[p] == k for p in triple) for k in range(3)]
        return 3 in tally or any(tally[k] == 2 and tally[(k + 1) % 3] == 1 for k in range(3))

    return [t for t in combinations(range(8), 3) if chosen(t)]


def covering_pairs(width: int) -> list[tuple[int, ...]]:
    """The pairs of byte positions of which every width + 1 positions contain one: those within each eight."""
    return [p for at in range(0, 8 * width, 8) for p in combinations(range(at, at + 8), 2)]


def _byte(position: int):
    return F.shiftrightunsigned(F.col(f"fp{position // 8}"), 8 * (position % 8)).bitwiseAND(F.lit(255))


def _keyed(fps: DataFrame, covering: list[tuple[int, ...]], width: int) -> DataFrame:
    """Each fingerprint under each of the index's keys: the covering set's number and its bytes."""
    keys = [sum((F.shiftleft(_byte(p), 8 * i) for i, p in enumerate(t)), F.lit(n).cast("long") * (1 << 24)) for n, t in enumerate(covering)]
    return fps.select(*fps.columns, F.explode(F.array(*keys)).alias("key"))


def _rekeyed(lists: DataFrame, covering: list[tuple[int, ...]], width: int) -> DataFrame:
    """Entries of long lists under each further position and its byte; a pair that passes the count filter shares one."""
    own = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in covering]), (F.shiftright("key", 24) + 1).cast("int"))
    further = [F.when(~F.array_contains(own, p), -1 - (F.col("key") * (2048 * width) + p * 256 + _byte(p))) for p in range(8 * width)]
    return lists.select(*(c for c in lists.columns if c not in ("key", "n")), F.explode(F.array_compact(F.array(*further))).alias("key"))


def _blocks(lists: DataFrame, bound: int, width: int) -> DataFrame:
    """Lists with their length n in groups of bounded size: one for a short list, one for each two blocks of a long one."""
    blocks = F.ceil(F.col("n") / bound).cast("int")
    own = F.pmod(F.xxhash64(*names(width)), F.col("blocks")).cast("int")
    dealt = lists.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct(*(c for c in lists.columns if c not in ("key", "n"))).alias("fp"))


def near_by(differing: np.ndarray, radius: int, least: int) -> np.ndarray:
    """Which differences (rows) pass: the tally of shared positional bytes reaches the minimum, and the bits verify."""
    differing = np.ascontiguousarray(differing)
    near = (differing.view(np.uint8).reshape(len(differing), -1) == 0).sum(axis=1) >= least
    near[near] = np.bitwise_count(differing[near].view(np.uint64)).sum(axis=1) <= radius
    return near


def spanning_links(members: np.ndarray, radius: int, least: int) -> np.ndarray:
    """Links between distinct ``members`` (rows) as pairs of their numbers, enough for the same components.

    Lists of moderate length are compared at once; a longer one is gone through from the first member on,
    each linked to the one that it is reached from.
    """
    if len(members) <= AT_ONCE:
        a, b = np.triu_indices(len(members), 1)
        near = near_by(members[a] ^ members[b], radius, least)
        return _forest(np.column_stack([a[near], b[near]]), len(members))
    rest, links = np.arange(len(members)), []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = np.zeros(len(rest), dtype=bool)
            for at in frontier:
                near = near_by(members[at] ^ members[rest], radius, least) & ~reached
                links += [(int(at), int(x)) for x in rest[near]]
                reached |= near
            frontier, rest = rest[reached], rest[~reached]
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def nearest_links(members: np.ndarray, radius: int, least: int) -> np.ndarray:
    """Like ``spanning_links``, with the nearest of the links: a tree of the least differing bits grows member by member."""
    rest, links = np.arange(1, len(members)), []
    bits, reached_from, at = np.full(len(rest), 1 << 30), np.zeros(len(rest), dtype=np.int64), 0
    while len(rest):
        differing = members[rest] ^ members[at]
        shared = (differing.view(np.uint8).reshape(len(rest), -1) == 0).sum(axis=1)
        own = np.bitwise_count(differing.view(np.uint64)).sum(axis=1).astype(np.int64)
        nearer = (own < bits) & (own <= radius) & (shared >= least)
        bits[nearer], reached_from[nearer] = own[nearer], at
        next_one = int(bits.argmin())
        at = int(rest[next_one])
        if bits[next_one] <= radius:
            links.append((int(reached_from[next_one]), at))
        rest, bits, reached_from = (np.delete(x, next_one) for x in (rest, bits, reached_from))
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def links_between(members: np.ndarray, labels: np.ndarray, radius: int, least: int, most: int) -> tuple[np.ndarray, bool]:
    """Links between distinct ``members`` (rows, in order) of different labels, of each two labels the ``most`` nearest; and whether there are more."""
    found = []
    for at in range(len(members) - 1):
        rest = at + 1 + np.flatnonzero(labels[at + 1 :] != labels[at])
        if len(rest):
            rest = rest[near_by(members[rest] ^ members[at], radius, least)]
            bits = np.bitwise_count((members[rest] ^ members[at]).view(np.uint64)).sum(axis=1).astype(np.int64)
            found.append(np.column_stack([np.minimum(labels[rest], labels[at]), np.maximum(labels[rest], labels[at]), bits, np.full(len(rest), at), rest]))
    if not found:
        return np.zeros((0, 2), dtype=np.int64), False
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    first = np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]
    place = np.arange(len(pairs)) - np.maximum.accumulate(np.where(first, np.arange(len(pairs)), 0))
    return pairs[place < most, 3:], bool((place >= most).any())


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Of links between ``n`` members those that join what no earlier one has joined, if there are more than members."""
    if len(pairs) <= n:
        return pairs
    top, kept = list(range(n)), []
    for k, (a, b) in enumerate(pairs.tolist()):
        while top[a] != a:
            a = top[a]
        while top[b] != b:
            b = top[b]
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append(k)
    return pairs[kept]


def links_of_lists(values: np.ndarray, offsets: np.ndarray, radius: int, least: int, tree=spanning_links) -> np.ndarray:
    """Links in lists (``values`` between ``offsets``) as pairs of places; short lists of one length are compared together, others by ``tree``."""
    sizes, found = np.diff(offsets), []
    for n in range(2, SHORT + 1):
        starts = offsets[:-1][sizes == n]
        a, b = np.triu_indices(n, 1)
        for at in range(0, len(starts), 1 << 14):
            own = starts[at : at + (1 << 14), None]
            left, right = (own + a).ravel(), (own + b).ravel()
            near = near_by(values[left] ^ values[right], radius, least)
            found.append(np.column_stack([left[near], right[near]]))
    for k in np.flatnonzero(sizes > SHORT).tolist():
        own = values[offsets[k] : offsets[k + 1]]
        order = np.lexsort(own.T[::-1])
        found.append(offsets[k] + order[tree(own[order], radius, least)])
    return np.concatenate([np.zeros((0, 2), dtype=np.int64), *found])


def links(fps: DataFrame, radius: int = 4, bound: int = LIST_BOUND, width: int = 1) -> DataFrame:
    """Links a, b between distinct fingerprints at ``radius`` or fewer bits, sparse but with the same components.

    Fingerprints of one integer are nodes as they are, wider ones as their hexadecimal digits.  Of three
    integers the links of a list are its nearest ones, as they are to be verified.
    """
    if width == 1 and not 0 <= radius <= 4:
        raise ValueError("the index finds pairs that share at least four of eight bytes")
    least = max(4, 8 - radius) if width == 1 else width + 1
    ends, tree = _ends(width), nearest_links if width == 3 else spanning_links

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets, values = np.asarray(lists.offsets), np.column_stack([lists.values.field(i).to_numpy() for i in range(width)])
            pairs = links_of_lists(values, offsets.astype(np.int64), radius, least, tree)
            yield pa.RecordBatch.from_arrays([pa.array(values[pairs[:, side], i]) for side in (0, 1) for i in range(width)], ends)

    found = _lists(fps.select(*names(width)), bound, width).mapInArrow(linked, ", ".join(f"{end} long" for end in ends)).distinct()
    return found.select(*(_node(end, width).alias(end) for end in "ab"))


def further_links(fps: DataFrame, radius: int, most: int, bound: int = LIST_BOUND, width: int = 3) -> DataFrame:
    """Links a < b between ``fps`` of different ``label``, of each list and two labels the ``most`` nearest; null where a list has more."""
    ends = _ends(width)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, found, more = batch.column(0), [np.zeros((0, 2), dtype=np.int64)], False
            offsets, values = np.asarray(lists.offsets).astype(np.int64), np.column_stack([lists.values.field(i).to_numpy() for i in range(width)])
            labels = lists.values.field(width).to_numpy()
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if (labels[start:end] != labels[start]).any():
                    order = start + np.lexsort(values[start:end].T[::-1])
                    pairs, cut = links_between(values[order], labels[order], radius, width + 1, most)
                    found.append(order[pairs])
                    more |= cut
            pairs = np.concatenate(found)
            columns = [pa.array(values[pairs[:, side], i]) for side in (0, 1) for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c, pa.nulls(int(more), pa.int64())]) for c in columns], ends)

    found = _lists(fps, bound, width).mapInArrow(linked, ", ".join(f"{end} long" for end in ends)).distinct()
    a, b = (_node(end, width) for end in "ab")
    return found.select(F.when(a < b, a).otherwise(b).alias("a"), F.when(a < b, b).otherwise(a).alias("b")).distinct()


def _ends(width: int) -> list[str]:
    return [f"{end}{i}" for end in "ab" for i in range(width)]


def _lists(fps: DataFrame, bound: int, width: int) -> DataFrame:
    """The index's lists of two and more of ``fps``, in blocks of bounded size, as arrays ``fps``; further columns go along."""
    covering = covering_triples() if width == 1 else covering_pairs(width)
    entries = _keyed(fps, covering, width)

    def counted(entries: DataFrame) -> DataFrame:
        sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # Entries are read off the fingerprints by an explode, which Spark's estimate of their size leaves out: it would broadcast them.
        return entries.join(sizes.hint("merge"), "key")

    sized = counted(entries)
    long = counted(_rekeyed(sized.where(F.col("n") > bound), covering, width))
    grouped = _blocks(sized.where(F.col("n") <= bound), bound, width).unionByName(_blocks(long, bound, width))
    return grouped.groupBy("key", "i", "j").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")


def _node(prefix: str, width: int):
    """A fingerprint as the node of a link."""
    if width == 1:
        return F.col(f"{prefix}0")
    return F.concat(*(F.lpad(F.hex(f"{prefix}{i}"), 16, "0") for i in range(width)))


def _salted(hashed: DataFrame) -> DataFrame:
    """Rows stored with a salt, so that what joins by fingerprint and salt has no hot key."""
    number = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.monotonically_increasing_id())
    return materialise(hashed.withColumn("salt", F.pmod(number, F.lit(SALTS)).cast("int")))


def similar_links(found: DataFrame, rows: DataFrame, shingle: int, similarity: float, width: int) -> DataFrame:
    """Those of the links ``found`` (a, b) between fingerprints whose texts have the ``similarity``.

    ``rows`` (row, fingerprint, text) are stored and ``row`` is unique; of rows with one fingerprint the
    first is read.  Texts are sketched once where a link names them; only sketches, at most 4 KB each,
    go to the links.  Where a text has more shingles than a sketch, whole sets go to the links of that text.
    """
    fp = names(width)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch, 1):
                part = batch.slice(a, b - a)
                found = [sketch(t, shingle).view(np.int32) for t in filled(part.column(1)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], ["node", "sketch"])
        let_go()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            pairs = ((left[i].values.to_numpy().view(np.uint32), right[i].values.to_numpy().view(np.uint32)) for i in range(len(batch)))
            holds = [None if max(map(len, pair)) >= SKETCH else similarity_of(*pair) >= similarity for pair in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(holds, pa.bool_())], ["a", "b", "holds"])
        let_go()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch, 1):
                part = batch.slice(a, b - a)
                found = [shingle_set(t, shingle).view(np.int64) for t in filled(part.column(1)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])
        let_go()

    def texts_of(links: DataFrame) -> DataFrame:
        named = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        first = rows.groupBy(*fp).agg(F.min("row").alias("row")).select("row", _node("fp", width).alias("node")).join(named, "node", "left_semi")
        return rows.select("row", "text").join(first, "row").select("node", "text")

    found = materialise(found)
    sketches = materialise(texts_of(found).mapInArrow(sketched, "node string, sketch array<int>"))
    pairs = found.join(sketches.toDF("a", "left"), "a").join(sketches.toDF("b", "right"), "b")
    told = materialise(pairs.select("a", "b", "left", "right").mapInArrow(verified, "a string, b string, holds boolean"))
    long = told.where("holds is null").select("a", "b")
    sets = materialise(texts_of(long).mapInArrow(whole, "node string, shingles array<bigint>"))
    met = long.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b")
    both = F.size(F.array_intersect("left", "right"))
    return told.where("holds").select("a", "b").unionByName(met.where(both / (F.size("left") + F.size("right") - both) >= similarity).select("a", "b"))


def verified_components(nodes: DataFrame, found: DataFrame, radius: int, width: int, verify) -> DataFrame:
    """(node, root) of all links within the filters that ``verify`` lets hold; ``nodes`` has node and fingerprint, ``found`` trees of links.

    A tree's link that fails may stand for others that hold.  Only the parts that failed links leave apart are searched
    anew, for links between two of them: the nearest ones of each list first, then ever more, as long as a list has more.
    """
    tried = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    holding = materialise(verify(tried))
    joined, most = connected_components(holding), BETWEEN
    parts = joined.toDF("node", "part")

    def apart(links: DataFrame) -> DataFrame:
        """Links as those of parts, without those within one; a node that has no link is a part."""
        a, b = (F.coalesce(f"part_{end}", end) for end in "ab")
        ends = (parts.toDF(end, f"part_{end}") for end in "ab")
        return links.join(next(ends), "a", "left").join(next(ends), "b", "left").select(a.alias("a"), b.alias("b")).where("a <> b")

    failed = apart(tried.join(holding, ["a", "b"], "left_anti"))
    touched = materialise(failed.select(F.explode(F.array("a", "b")).alias("part")).distinct())
    if touched.isEmpty():
        return joined
    members = nodes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    members = materialise(members.join(touched, "part", "left_semi").select("node", "part", *names(width)))
    while True:
        between = materialise(further_links(members.select(*names(width), F.xxhash64("part").alias("label")), radius, most, width=width))
        held = materialise(verify(between.where("a is not null").join(tried, ["a", "b"], "left_anti")))
        if not held.isEmpty():
            parts = members.select("node", "part")
            roots = connected_components(apart(held))
            joined = joined.unionByName(members.select("node", F.col("part").alias("root"))).distinct()
            joined = joined.join(roots.toDF("root", "further"), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            members = materialise(members.join(roots.toDF("part", "further"), "part", "left").select("node", F.coalesce("further", "part").alias("part"), *names(width)))
        if between.where("a is null").isEmpty():
            return joined
        most *= BETWEEN


def _labelled(hashed: DataFrame, radius: int, width: int, verify=None) -> DataFrame:
    """Stored rows (doc_id, fingerprint, salt) with their component's node ``root`` and component_id, the smallest doc_id that links reach.

    ``verify`` takes links and returns those that hold."""
    fp = names(width)
    groups = materialise(hashed.groupBy(*fp, "salt").agg(F.min("doc_id").alias("first")))
    fps = materialise(groups.groupBy(*fp).agg(F.min("first").alias("first")))
    found = links(fps.select(*fp), radius, width=width)
    # Only fingerprints with a link can take another document's id.
    nodes = fps.withColumn("node", _node("fp", width))
    components = verified_components(nodes.drop("first"), found, radius, width, verify) if verify else connected_components(found)
    members = components.join(nodes, "node")
    roots = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(roots, "root").select(*fp, "root", "component_id")
    alone = F.col("root").isNull()
    labels = nodes.join(named, fp, "left").select(*fp, F.coalesce("root", "node").alias("root"), F.when(alone, F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    # A fingerprint's documents are met by its label at SALTS keys, not at one.
    return hashed.join(groups.select(*fp, "salt").join(labels, fp), [*fp, "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, width: int = 1) -> DataFrame:
    """doc_id, fingerprint in hexadecimal, component_id: the smallest doc_id that links reach, itself included."""
    hashed = _salted(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, width))
    hexadecimal = F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in names(width))))
    return _labelled(hashed, radius, width).select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, shingle: int = 5, radius: int = SIMILAR, width: int = 3, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; all columns are kept.

    Links of wide fingerprints are verified by the ``similarity`` of the texts' shingles.

    Of rows that share that id, all whose text is another stay if they are of other components, and of
    those with its fingerprint the first in the order of their text; rows without id cannot be told
    apart and all stay.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    key, text = (f"c{docs.columns.index(name)}" for name in ("doc_id", "text"))
    told = plain.withColumn("doc_id", F.col(key).cast("long")).withColumn("text", F.col(text)).withColumn("row", F.monotonically_increasing_id())
    marked = materialise(fingerprints(told, shingle, width))
    fp = names(width)
    rows = marked.select("row", *fp, F.col(text).alias("text"))
    verify = (lambda found: similar_links(found, rows, shingle, similarity, width)) if width > 1 else None
    labelled = _labelled(_salted(marked.select("doc_id", *fp)), radius, width, verify).where("doc_id is not null")
    # Of a component the row of the smallest id, and of several with it that of the smallest fingerprint.
    firsts = labelled.where("doc_id = component_id").groupBy("root", "doc_id", *fp).agg(F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct("doc_id", *fp, "n")).alias("row")).select("row.*")
    kept = marked.join(firsts, ["doc_id", *fp])
    others = [F.xxhash64(*[c for c in plain.columns if c != text])] if len(plain.columns) > 1 else []
    single = kept.where("n = 1").select(*plain.columns)
    several = kept.where("n > 1").groupBy("doc_id", *fp).agg(F.min_by(F.struct(*plain.columns), F.struct(text, *others)).alias("row")).select("row.*")
    return single.unionByName(several).unionByName(marked.where("doc_id is null").select(*plain.columns)).toDF(*docs.columns)
