"""Near-duplicates by order MinHash, verified by banded alignment.

A text's k-mers are runs of three words, each labelled with how often it has occurred before. One sketch takes the
`width` k-mers with the smallest hashes and keeps them in text order, so it is the same for two texts only if they
share these k-mers in this order: it follows edit similarity, not the sets alone. Texts that share any of `sketches`
sketches are candidates: of two texts at the limit of similarity, 0.8, about 0.95 are with 20 words and 0.99 with 150
(`width` 2, 24 sketches). A pair is a link if the edit distance of their words is at most 1 - similarity of the longer
text: equal ends are stripped, the bags of words give a lower bound, and what is left is aligned on the diagonals
within the allowed distance.

Equal texts count once from the start. A bucket of candidates is compared with one of its members at a time, by
rounds: a star of pairs, not all pairs. Links are joined to classes after each round; a bucket is done when all of it is
in one class, and the others take another member as their centre for a next round. The first round takes the buckets of the
first few sketches only, which join most copies, so that a large group isn't compared anew for each sketch. What few rounds leave mixed is
compared pair by pair, in blocks of a bucket: all pairs in different classes whose lengths and counts of words, the
latter in BINS bins, allow a link are aligned, but for those whose classes the block's links have joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import WordIndex, drop, map_rows, save

K, MIX = 3, np.uint64(0x9E3779B97F4A7C15)
BINS, BLOCK, HELD = 256, 512, 5_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads neighbours."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def seeds(sketches: int) -> np.ndarray:
    return mixed(np.arange(1, sketches + 1, dtype=np.uint64) * MIX) | np.uint64(1)


def sketch(words: np.ndarray, seed: np.ndarray, width: int) -> np.ndarray:
    """One key for each seed. Fewer than K words are one k-mer; without a word there is no key."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    w, kmers = mixed(words.astype(np.uint64) + MIX), np.zeros(max(1, n - K + 1), np.uint64)
    for i in range(min(n, K)):
        kmers = kmers * np.uint64(0xD6E8FEB86659FD93) + w[i : i + len(kmers)]
    order = np.argsort(kmers, kind="stable")
    same = np.concatenate([[False], np.diff(kmers[order]) == 0])
    places = np.arange(len(kmers))
    before = np.empty(len(kmers), np.uint64)
    before[order] = places - np.maximum.accumulate(np.where(same, 0, places))
    labelled = mixed(kmers + before * MIX)
    out = np.empty(len(seed), np.uint64)
    step = max(1, 200_000 // len(kmers))
    for at in range(0, len(seed), step):
        h = mixed((labelled[None] ^ seed[at : at + step, None]) * seed[at : at + step, None])
        rows, found = np.arange(len(h)), []
        for _ in range(min(width, len(kmers))):
            found.append(h.argmin(1))
            h[rows, found[-1]] = np.iinfo(np.uint64).max
        key = np.zeros(len(h), np.uint64)
        for column in np.sort(np.stack(found, 1), axis=1).T:
            key = mixed(key * MIX + labelled[column])
        out[at : at + step] = key
    return out.view(np.int64)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is at most `most`, else most + 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    n = len(a)
    front = int((a != b[:n]).argmax()) if (a != b[:n]).any() else n
    a, b = a[front:], b[front:]
    n = len(a)
    if n:
        back = a[::-1] != b[::-1][:n]
        end = int(back.argmax()) if back.any() else n
        a, b = a[: n - end], b[: len(b) - end]
    n, m = len(a), len(b)
    if not n:
        return m
    _, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    bag = np.bincount(places[:n], minlength=places.max() + 1) - np.bincount(places[n:], minlength=places.max() + 1)
    if max(bag.clip(0).sum(), (-bag).clip(0).sum()) > most:
        return most + 1
    band = 16
    while (d := banded(places[:n].tolist(), places[n:].tolist(), band := min(band, most))) > band and band < most:
        band *= 6
    return min(d, most + 1)


def banded(a: list[int], b: list[int], band: int) -> int:
    """Edit distance of a and b, a being no longer, if it is at most `band`; else some number over it.

    Column by column, the vertical steps of the `band` rows on either side of the diagonal are held in the bits of two
    numbers, which move down a row with each column (after Myers 1999). Rows over the first count up from it as if
    they were there; below and above the band steps are taken to cost one more, which no path within it needs.
    """
    rows: dict[int, int] = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    whole, top = (1 << 2 * band + 1) - 1, 1 << 2 * band
    down = (1 << band + 1) - 1  # steps of minus one
    up = whole ^ down  # steps of plus one
    goal = 1 << len(a) - len(b) + band if len(b) - len(a) <= band else 0
    d = len(b) - len(a)
    get = rows.get
    for j, x in enumerate(b, 1):
        up, down = up >> 1 | top, down >> 1
        same = get(x, 0)
        if same:
            shift = j - band - 1
            same = (same >> shift if shift >= 0 else same << -shift) & whole
        level = ((same & up) + up ^ up | same | down) & whole  # where the diagonal step is free
        right_up, right_down = (down | ~(level | up)) << 1 | 1, (up & level) << 1
        up, down = (right_down | ~(level | right_up)) & whole, right_up & level
        if not level & goal:
            d += 1
            if d > band:
                break
    return d


def bag(words: np.ndarray) -> bytes:
    return np.minimum(np.bincount(words % np.uint32(BINS), minlength=BINS), 255).astype(np.uint8).tobytes()


def sketched(docs: DataFrame, key: str, text: str, sketches: int, width: int) -> DataFrame:
    """doc_id, node (a hash of the text), n_words, keys, words (32-bit hashes), bag (counts of words by bin, to 255) for each row."""
    seed = seeds(sketches)

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        index, hashes = WordIndex(200_000), np.zeros(0, np.uint32)
        for p in parts:
            known, cuts, new = index.look_up(pc.utf8_lower(pa.array(p["text"], pa.binary()).fill_null(b"").cast(pa.string())))
            fresh = np.array([zlib.crc32(w.encode()) for w in new.to_pylist()], np.uint32)
            hashes = fresh if len(new) == len(index.words) else np.concatenate([hashes, fresh])
            flat = hashes[known]
            words = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
            yield {"doc_id": p["doc_id"], "node": p["node"], "n_words": [len(w) for w in words], "keys": [sketch(w, seed, width) for w in words], "words": [w.astype("<u4").tobytes() for w in words], "bag": [bag(w) for w in words]}

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("node"), F.col(text).alias("text"))
    return map_rows(own, "doc_id long, node long, n_words int, keys array<long>, words binary, bag binary", rows, batch=512)


def allowed(n: np.ndarray, comp: np.ndarray, side: np.ndarray, bags: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members in different classes, on different sides if there are two, whose lengths and bags allow a link."""
    most = np.floor((1 - similarity) * np.maximum(n[:, None], n) + 1e-9)
    ok = np.triu((comp[:, None] != comp) & (abs(n[:, None] - n) <= most), 1)
    if side.any() and not side.all():
        ok &= side[:, None] != side
    i, j = np.nonzero(ok)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        x, y = i[at : at + 4096], j[at : at + 4096]
        more = bags[x] - bags[y]
        gained = np.maximum(more, 0).sum(1, dtype=np.int64)
        keep[at : at + 4096] = np.maximum(gained, gained - more.sum(1, dtype=np.int64)) <= most[x, y]
    return i[keep], j[keep]


def joined(i: list[int], j: list[int], comp: list[int], words: list[bytes | None], own: list[set[int]], bucket: int, similarity: float) -> Iterator[tuple[int, int, float | None]]:
    """Of pairs of a block's members, those that are links, with their similarity; None where a text is too long to be held here.

    A pair counts in the first of the open buckets that it shares, and classes that a link has joined need no other.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for p, q in zip(i, j):
        if find(comp[p]) == find(comp[q]) or min(own[p] & own[q]) != bucket:
            continue
        if words[p] is None or words[q] is None:
            yield p, q, None
            continue
        x, y = np.frombuffer(words[p], "<u4"), np.frombuffer(words[q], "<u4")
        longest = max(len(x), len(y))
        most = int((1 - similarity) * longest + 1e-9)
        d = distance(x, y, most)
        if d <= most:
            parent[find(comp[p])] = find(comp[q])
            yield p, q, 1 - d / longest if longest else 1.0


def remaining(open_: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """a, b, similarity: the links among members of mixed buckets (bucket, node, n_words, size, comp) in different classes.

    A bucket's members are dealt over stripes of `block` or so, and each two stripes meet in a block of their own, so no
    task holds a whole bucket. Pairs that allowed() leaves are aligned there. Texts of more than `held` words aren't held in
    blocks: their pairs have a null similarity, and are still to be verified. texts: node, bag, words.
    """

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        own: tuple | None = None
        members: list[tuple] = []

        def met(out: dict[str, list]) -> None:
            node, n, comp, side, bags_, words, places = zip(*members)
            flat = np.frombuffer(b"".join(bags_), np.uint8).reshape(len(node), BINS).astype(np.int16)
            i, j = allowed(np.array(n, np.int64), np.array(comp, np.int64), np.array(side, bool), flat, similarity)
            for p, q, alike in joined(i.tolist(), j.tolist(), comp, words, [set(x) for x in places], own[0], similarity):
                for to, v in zip(out.values(), (min(node[p], node[q]), max(node[p], node[q]), alike)):
                    to.append(v)

        for p in parts:
            out: dict[str, list] = {"a": [], "b": [], "similarity": []}
            for block_, *member in zip(zip(p["bucket"], p["low"], p["high"]), p["node"], p["n_words"], p["comp"], p["side"], p["bag"], p["words"], p["places"]):
                if block_ != own:
                    if len(members) > 1:
                        met(out)
                    own, members = block_, []
                members.append(tuple(member))
            yield out
        if len(members) > 1:
            met(out := {"a": [], "b": [], "similarity": []})
            yield out

    stripes = F.ceil(F.col("size") / block).cast("int")
    places = open_.groupBy("node").agg(F.collect_set("bucket").alias("places"))
    members = places.join(texts.select("node", "bag", F.when(F.octet_length("words") <= 4 * held, F.col("words")).alias("words")), "node")
    dealt = open_.select("bucket", "node", "n_words", "comp", stripes.alias("stripes")).withColumn("stripe", F.pmod(F.xxhash64("node", F.lit(-1)), "stripes").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("other")).join(members, "node")
    blocks = dealt.select("bucket", F.least("stripe", "other").alias("low"), F.greatest("stripe", "other").alias("high"), "node", "n_words", "comp", (F.col("stripe") > F.col("other")).alias("side"), "bag", "words", "places")
    own = ["bucket", "low", "high"]
    tasks = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as blocks are few bytes but much work, and would be put together
    return map_rows(blocks.repartition(tasks, *own).sortWithinPartitions(*own), "a long, b long, similarity double", rows, batch=1024, binary=())


def verify(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose edit similarity is at least `similarity`, with it."""

    def rows(parts: Iterator[dict[str, list]]) -> Iterable[dict[str, list]]:
        for p in parts:
            out: dict[str, list] = {"a": [], "b": [], "similarity": []}
            for a, b, x, y in zip(p["a"], p["b"], p["x"], p["y"]):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                longest = max(len(x), len(y))
                most = int((1 - similarity) * longest + 1e-9)
                d = distance(x, y, most)
                if d <= most:
                    for k, v in zip(out, (a, b, 1 - d / longest if longest else 1.0)):
                        out[k].append(v)
            yield out

    left, right = words.select(F.col("node").alias("a"), F.col("words").alias("x")), words.select(F.col("node").alias("b"), F.col("words").alias("y"))
    return map_rows(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a long, b long, similarity double", rows, binary=())


def classes(links: DataFrame) -> DataFrame:
    """node, comp for each node with a link: the smallest node of those it is connected with.

    Each step moves a node to the smallest of itself and its neighbours; links move with their ends, and those within one
    place go. What was connected stays so, so when no link is left each place is the smallest node of its class.
    """
    edges, label = save(links.select("a", "b").distinct(), "edges"), None
    while label is None or edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = save(both.groupBy(F.col("a").alias("comp")).agg(F.least("a", F.min("b")).alias("to")), "moves")
        label = save(move.select(F.col("comp").alias("node"), F.col("to").alias("comp")) if label is None else label.join(move, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        moved = edges.join(move.select(F.col("comp").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("comp").alias("b"), F.col("to").alias("y")), "b")
        edges = save(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return label


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, sketches: int = 24, width: int = 2, stars: int = 3, early: int = 4) -> DataFrame:
    """doc_id, class_id, n_links, n_words, node, comp for each row of docs; comp names the class by the least text hash (node) in it.

    class_id: the smallest key in the row's class, null only if all of them are; rows with equal texts (null and empty
    ones are equal) are always in one class. n_links: other texts that its own is verified to be similar to. Other columns are
    left out. early: of how many sketches the first star is. Words are compared without case. Texts of fewer than five words have no near copies but those of the same
    words, as one edit is over 0.2 of them.
    """
    table = save(sketched(docs, key, text, sketches, width), "sketched")
    texts = table.dropDuplicates(["node"])
    keyed = texts.select("node", "n_words", F.posexplode("keys").alias("sketch", "key")).select("node", "n_words", "sketch", F.xxhash64("sketch", "key").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = save(keyed.join(sizes, "bucket"), "buckets")
    # A text with its buckets, of which there are `sketches` at most: later rounds label texts, not their places in buckets.
    placed = save(buckets.groupBy("node").agg(F.first("n_words").alias("n_words"), F.collect_list(F.struct("bucket", "size")).alias("places")), "placed")
    words = save(texts.select("node", "words").join(placed.select("node"), "node", "left_semi"), "words")
    pair = F.struct(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    longest, shortest = F.greatest("n_words", "centre_words"), F.least("n_words", "centre_words")
    possible = F.expr("node <> centre") & (longest - shortest <= (1 - similarity) * longest + 1e-9)
    links = tried = None
    for number in range(stars + 1):
        if number:
            labelled = placed.join(classes(links), "node", "left").select("node", "n_words", F.coalesce("comp", "node").alias("comp"), F.explode("places").alias("place")).select("node", "n_words", "comp", "place.*")
        else:
            labelled = buckets.filter(F.col("sketch") < early).withColumn("comp", F.col("node"))
        if number > 1:
            labelled = labelled.filter("size > 2")  # two members have met
        centre = F.struct(F.xxhash64("node", F.lit(number)).alias("h"), F.col("node").alias("centre"), F.col("n_words").alias("centre_words"), F.col("comp").alias("centre_comp"))
        many = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(centre).alias("m")).filter("low < high").select("bucket", "m.*")
        many = save(many, "mixed")
        if not many.limit(1).count() and number:
            break
        open_ = labelled.join(many, "bucket")
        if number < stars:
            own = open_.filter(possible & (F.col("comp") != F.col("centre_comp")))
            pairs = own.select(pair.alias("p")).select("p.*").distinct()
        else:
            last = save(remaining(open_, texts.select("node", "bag", "words"), similarity), "last")
            links = links.unionByName(last.filter("similarity is not null").dropDuplicates(["a", "b"]))
            pairs = last.filter("similarity is null").select("a", "b").distinct()
        pairs = save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = save(verify(pairs, words, similarity), "links")
        links = found if links is None else links.unionByName(found)
    comps = classes(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    members = save(table.select("doc_id", "node", "n_words").join(comps, "node", "left").join(degree, "node", "left").select("doc_id", "node", "n_words", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "members")
    drop(table, buckets, placed, words)  # the large ones; members need them no more
    names = members.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return members.join(names, "comp").select("doc_id", "class_id", "n_links", F.col("n_words").cast("long").alias("n_words"), "node", "comp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "comp")
