"""Similarity self-join on distinct word n-grams by Jaccard, through token-combination prefixes.

Sets are 64-bit n-gram hashes. Copies with one set are one class from the start, so no pair of copies is
ever made. Of the classes' representatives:

1. Sieve. In the order of the hashes, two sets that link share at least k = tau // 2 + 1 of their first tau + k + 2
   tokens (tau: tokens that a set can lose; the 2 make up for a partner of another size). A set of which fewer
   than k such tokens stand in any other set's prefix links with none and goes. The sieve runs twice, the second time among those that passed.
2. Index. Document frequencies are counted among the sets that passed and tokens go rare first. A rare token signs by
   itself. Frequent tokens fall by hash into small groups and sign in pairs of a group: c tokens of a group are c - 1
   units, as that many must be lost before no pair is left. The prefix runs on until its units exceed the
   tokens that the set can lose: fewer to a longer partner (the index role) than to a shorter one (the
   probe role). Signatures carry a size class, so partners of other lengths never meet.
3. Verify. Sets with a signature in common form candidate groups. Within blocks of a group, the set
   with the fewest rare tokens goes first: overlaps with all others are counted exactly, links are kept, and what
   is connected is not compared again, so a large group of near copies of one text costs one pass. Where
   a group has several blocks and is not yet one component, the same is done signature by signature: the sets outside a signature's main
   component meet all of its blocks, so texts that a chain of signatures put into one group are not compared. Whole groups are
   compared so only where that sends fewer rows.

Every link between different sets is either verified or lies within a component that other links connect, so
components are exact. Hot tokens and copies are
counted by partial sums and joined by plans that split skewed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.components import components
from palimpsest.llm.tables import join_sized
from palimpsest.session import discard, durable, prepare

FREQUENT = 32
BLOCK_ROWS, BLOCK_TOKENS = 256, 1 << 20


def text_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct n-grams of each text, by row and hash; of a shorter text its whole sequence."""
    w = K.words(data, offsets, K.SPACE, K.LOWER)
    h, row, _ = K.shingles(w, words)
    counts = K.per_row(w.doc, len(offsets) - 1)
    parts, rows = [h], [row]
    for k in range(1, words):
        if (counts == k).any():
            hk, rk, _ = K.shingles(w, k)
            own = counts[rk] == k
            parts.append(hk[own])
            rows.append(rk[own])
    return K.distinct_in_row(np.concatenate(parts), np.concatenate(rows))


def losses(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that a set of n can lose to a partner of any size, and to one that is no smaller."""
    any_size = n - -(-percent * n // 100)
    longer = n - -(-2 * percent * n // (100 + percent))
    return any_size, longer


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _digest(words: int, percent: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                rows = len(c.offsets) - 1
                h, row = text_sets(c.bytes, c.offsets, words)
                n = K.per_row(row, rows)
                starts = np.concatenate(([0], np.cumsum(n)))
                keys = batch.column(0).slice(c.first, rows)
                if whole:
                    yield pa.RecordBatch.from_arrays([keys, _lists(h, starts)], names=["doc", "tokens"])
                    continue
                prints = []
                for seed in (21, 22):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(h + np.uint64(seed)), dtype=np.uint64)))
                    prints.append(pa.array((sums[starts[1:]] - sums[starts[:-1]]).view(np.int64)))
                most = losses(n, percent)[0]
                head = np.minimum(n, most + most // 2 + 3)
                first = np.arange(len(h)) - starts[row] < head[row]
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), *prints, _lists(h[first], np.concatenate(([0], np.cumsum(head))))], names=["doc", "n", "print1", "print2", "head"])

    return run


def _sieve(heads: DataFrame) -> DataFrame:
    """doc, need, head of the sets that share enough of their heads with others."""
    tokens = heads.select("doc", F.explode("head").alias("token"))
    shared = tokens.groupBy("token").count().filter("count >= 2").select("token")
    enough = durable(tokens.join(shared.hint("merge"), "token").groupBy("doc").count(), "enough")
    return durable(join_sized(heads, enough, "doc").filter("count >= need").select("doc", "need", "head"), "sieved")


def signatures(n: int, tokens: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, whether in the index role) of a set of n tokens, of which `tokens` stand in other sets too."""
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    single = n - len(tokens)  # rare tokens that no other set has come first and cost a unit each
    size = int(np.floor(np.log(n) / -np.log(percent / 100) + 1e-9))
    any_size, longer = losses(np.array([n]), percent)
    out, roles = [], []
    for indexed, budget, sizes in ((True, int(longer[0]), (size,)), (False, int(any_size[0]), (size, size - 1) if size else (size,))):
        for own in sizes:
            groups = max(1, int((100 / percent) ** own * (100 - percent) / 400))
            left = budget + 1 - single
            if left <= 0:
                continue
            rare = df <= FREQUENT
            group = np.where(rare, -1, (K.mix(tokens ^ np.uint64(own)) % np.uint64(groups)).astype(np.int64))
            units = np.ones(len(tokens), dtype=np.int64)
            _, first = np.unique(group, return_index=True)
            units[first[group[first] >= 0]] = 0
            total = np.cumsum(units)
            stop = int(np.searchsorted(total, left)) + 1 if len(total) and total[-1] >= left else len(tokens)
            salt = np.uint64((own * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
            out.append(K.mix(tokens[:stop][rare[:stop]] + salt))
            for g in np.unique(group[:stop][~rare[:stop]]):
                members = np.sort(tokens[:stop][group[:stop] == g])
                i, j = np.triu_indices(len(members), 1)
                out.append(K.mix(K.mix(members[i] + salt) * np.uint64(3) + members[j]))
            roles.append((sum(map(len, out)), indexed))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    sig = np.concatenate(out)
    role, at = np.zeros(len(sig), dtype=bool), 0
    for end, indexed in roles:
        role[at:end], at = indexed, end
    keep = np.lexsort((~role, sig))
    sig, role = sig[keep], role[keep]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = sig[1:] != sig[:-1]
    return sig[new], role[new]


def _sign(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sigs, roles = [], [], []
            for doc, n, shared in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                pairs = shared.values
                tokens = pairs.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
                sig, role = signatures(n, tokens, pairs.field("df").to_numpy(zero_copy_only=False), percent)
                docs += [doc.as_py()] * len(sig)
                sigs.append(sig)
                roles.append(role)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(roles))], names=["doc", "sig", "indexed"])

    return run


def links_in_block(n: np.ndarray, values: np.ndarray, owner: np.ndarray, label: np.ndarray, order: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows that connect all that links connect. Rows of one label are connected already."""
    rows = len(n)
    parent = np.unique(label, return_inverse=True)[1].astype(np.int64)  # component number by row
    left = len(np.unique(parent))
    token, kind = np.unique(values, return_inverse=True)
    by_kind = np.argsort(kind, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(kind, minlength=len(token)))))
    first = np.concatenate(([0], np.cumsum(n)))
    out = []
    for i in order:
        if left == 1:
            break
        kinds = kind[first[i] : first[i + 1]]
        sizes = starts[kinds + 1] - starts[kinds]
        at = np.repeat(starts[kinds] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        overlap = np.bincount(owner[by_kind[at]], minlength=rows)
        close = np.flatnonzero((overlap * 100 >= percent * (n[i] + n - overlap)) & (parent != parent[i]))
        for j in close:
            if parent[j] != parent[i]:
                out.append((int(i), int(j)))
                parent[parent == parent[j]] = parent[i]
                left -= 1
    return out


def _verify(percent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        doc = group["doc"].combine_chunks()
        tokens = group["tokens"].combine_chunks()
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.combine_chunks()
        n = np.diff(tokens.offsets.to_numpy())
        values = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        label = group["label"].to_numpy()
        order = np.lexsort((doc.to_numpy(zero_copy_only=False), group["rare"].to_numpy()))
        found = links_in_block(n, values, owner, label, order, percent)
        return pa.table({"a": doc.take(pa.array([a for a, _ in found], pa.int64())), "b": doc.take(pa.array([b for _, b in found], pa.int64()))})

    return run


def _compare(blocks: DataFrame, keys: list[str], percent: int) -> DataFrame:
    kind = dict(blocks.dtypes)["doc"]
    return blocks.select(*keys, "doc", "tokens", "rare", "label").groupBy(*keys).applyInArrow(_verify(percent), f"a {kind}, b {kind}")


def _in_blocks(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds the block of each row in its group; the group's most central set goes to all its blocks."""
    joined = join_sized(sets, groups, "group")
    own = joined.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    centre = joined.filter(F.col("doc") == F.col("centre")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return own.filter(F.col("doc") != F.col("centre")).unionByName(centre)


def find_links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect what links connect, among sets (doc, tokens array<long>) with distinct tokens."""
    tokens = sets.select("doc", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2")
    shared = tokens.join(df.hint("merge"), "token").groupBy("doc", "n").agg(F.collect_list(F.struct("token", "df")).alias("shared"))
    shared = shared.withColumn("rare", F.expr("n - size(shared)")).filter(F.expr(f"rare <= n - ceil({percent} * n / 100)"))
    shared = durable(shared, "shared")
    kind = dict(sets.dtypes)["doc"]
    signed = durable(shared.select("doc", "n", "shared").mapInArrow(_sign(percent), f"doc {kind}, sig long, indexed boolean"), "signatures")
    heads = signed.groupBy("sig").agg(F.min("doc").alias("root"), F.count(F.lit(1)).alias("docs"), F.max("indexed").alias("any")).filter("docs >= 2 AND any")
    edges = signed.join(heads.hint("merge"), "sig").filter("doc <> root").select("doc", "root").distinct()
    group = components(edges, "doc", "root")
    members = join_sized(join_sized(sets, group.withColumnRenamed("node", "doc").withColumnRenamed("component", "group"), "doc"), shared.select("doc", "rare"), "doc")
    members = durable(members.withColumn("label", F.col("doc")), "members")
    discard(shared)
    size = members.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).alias("tokens"), F.min_by("doc", F.struct("rare", "doc")).alias("centre"))
    size = durable(size.select("group", "centre", _blocks(F.col("docs"), F.col("tokens")).alias("blocks")), "groups")
    wide = size.filter("blocks > 1").select("group")
    one_block = not wide.limit(1).count()
    if one_block:
        discard(signed)
    links = durable(_compare(_in_blocks(members, size), ["group", "block"], percent), "links")
    if not one_block:
        links = links.unionByName(_across_blocks(members, wide, signed, links, percent))
        discard(signed)
    discard(members)
    return links


def _blocks(docs: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(docs / BLOCK_ROWS), F.ceil(tokens / BLOCK_TOKENS), F.lit(1))


def _unlinked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The parts (by keys) of more than one label: main label, blocks of its sets (major) and of the others (minor), and the rows `sent` to compare the others with all."""
    kinds = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("tokens"))
    first = F.struct("docs", "label")
    main = kinds.groupBy(*keys).agg(F.max_by("label", first).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("docs").alias("all"), F.sum("tokens").alias("tokens"), F.max("docs").alias("mains"), F.max_by("tokens", first).alias("main_tokens"))
    main = main.filter("labels > 1").withColumn("minors", F.col("all") - F.col("mains"))
    main = main.withColumn("major", _blocks(F.col("mains"), F.col("main_tokens"))).withColumn("minor", _blocks(F.col("minors"), F.col("tokens") - F.col("main_tokens")))
    return main.select(*keys, "main", "major", "minor", F.expr("mains * minor + minors * (major + minor)").cast("decimal(38,0)").alias("sent"))


def _across_blocks(members: DataFrame, wide: DataFrame, signed: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links across the blocks of groups that are not one component yet: each block of the sets outside
    a part's main component against every block of the part. Parts are the sets of one signature, each different collection of sets once, or the whole
    group where that sends fewer rows (near copies of one text share many signatures); two sets that link share a signature, so either way finds all."""
    labels = components(links, "a", "b").withColumnRenamed("node", "doc").withColumnRenamed("component", "found")
    rows = join_sized(members.drop("label"), wide, "group", "left_semi")
    rows = durable(join_sized(rows, labels, "doc", "left").withColumn("label", F.coalesce("found", "doc")).drop("found"), "labelled")
    slim = rows.select("doc", "group", "label", F.size("tokens").alias("size"))
    groups = durable(_unlinked(slim, ["group"]), "unlinked")
    slim = join_sized(slim, groups.select("group"), "group", "left_semi")
    shares = durable(signed.join(slim.hint("merge"), "doc"), "shares")
    alike = F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")
    sigs = shares.groupBy("group", "sig").agg(F.count(F.lit(1)).alias("docs"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("indexed").alias("any"), *alike)
    sigs = sigs.filter("low <> high AND any").groupBy("group", "docs", "x", "y").agg(F.min("sig").alias("sig"))
    shares = durable(shares.drop("indexed").join(sigs.select("sig").hint("merge"), "sig"), "by-signature")
    parts = durable(_unlinked(shares, ["group", "sig"]), "parts")
    fewer = groups.join(parts.groupBy("group").agg(F.sum("sent").alias("fewer")), "group", "left").filter("coalesce(fewer, 0) < sent")
    fewer = durable(fewer.select("group"), "fewer")
    which = lambda name, whole: (F.col(name).cast("long").alias("part"), F.lit(whole).alias("whole"))
    plan = ("main", "major", "minor")
    parts = join_sized(groups, fewer, "group", "left_anti").select(*which("group", True), *plan).unionByName(join_sized(parts, fewer, "group", "left_semi").select(*which("sig", False), *plan))
    shares = join_sized(slim, fewer, "group", "left_anti").select("doc", "label", *which("group", True)).unionByName(join_sized(shares, fewer, "group", "left_semi").select("doc", "label", *which("sig", False)))
    dealt = join_sized(shares, durable(parts, "parts-of-both"), ["whole", "part"])
    number = lambda n: F.pmod(F.xxhash64("doc"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    is_main = F.col("label") == F.col("main")
    major = dealt.filter(is_main).withColumn("j", number(F.col("major"))).withColumn("i", F.explode(upto("minor")))
    minor = dealt.filter(~is_main).withColumn("own", number(F.col("minor")))
    to_major = minor.withColumn("i", F.col("own")).withColumn("j", F.explode(upto("major")))
    to_minor = minor.withColumn("other", F.explode(upto("minor"))).withColumn("i", F.least("own", "other")).withColumn("j", -1 - F.greatest("own", "other"))
    keys = ["whole", "part", "i", "j"]
    tasks = major.select(*keys, "doc").unionByName(to_major.select(*keys, "doc")).unionByName(to_minor.select(*keys, "doc"))
    return durable(_compare(tasks.join(rows.hint("merge"), "doc"), keys, percent), "links")


def _by_row(body: DataFrame, key: str, words: int, percent: int) -> DataFrame:
    """jaccard_components() where keys don't tell documents apart: rows get numbers, and components the least key of their rows."""
    rows = durable(body.withColumn("row", F.monotonically_increasing_id()), "rows")
    own = jaccard_components(rows, "row", "__text", words, percent).withColumnRenamed("row", "__row")
    own = durable(own.join(rows.select(F.col("row").alias("__row"), "doc").hint("merge"), "__row"), "own")
    wide = own.groupBy(F.col("component_id").alias("__component")).agg(F.min("doc").alias("__least"), F.count(F.lit(1)).alias("__rows")).filter("__rows > 1")
    out = join_sized(own, durable(wide.select("__component", "__least"), "least"), F.col("component_id") == F.col("__component"), "left")
    return out.select(F.col("doc").alias(key), "n_shingles", F.when(F.col("__component").isNull(), F.col("doc")).otherwise(F.col("__least")).alias("component_id"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles (size of the set), component_id (the least key that links reach): one row a document.

    Words are runs of non-space bytes with A-Z in lower case; a text with fewer than `words` has its whole sequence as
    its set, a null, empty or blank one an empty set that links with nothing. Two sets link when 100 * |intersection| >= percent * |union|.
    Repeated rows are copies. Rows that repeat a key with another text, and rows without a key, are documents of their own: each has its own set and links, and a
    component has the least key of its rows (null if none has one). Texts of any length are read whole. An empty table gives an empty result. Key: an integer column. Other columns
    are not looked at, whatever their names.
    """
    prepare(docs.sparkSession)
    body = docs.select(F.col(key).alias("doc"), F.col(text).alias("__text"))
    kind = body.dtypes[0][1]
    heads = durable(body.mapInArrow(_digest(words, percent, False), f"doc {kind}, n long, print1 long, print2 long, head array<long>"), "heads")
    whole = ["n", "print1", "print2"]
    digest = durable(heads.drop("head"), "sets")
    classes = durable(digest.filter("n > 0").groupBy(*whole).agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    if classes.groupBy("rep").count().filter("count > 1 OR rep IS NULL").limit(1).count():
        for written in (heads, digest, classes):
            discard(written)
        return _by_row(body, key, words, percent)
    reps = join_sized(heads.select("doc", "n", "head"), classes.select("rep").distinct(), F.col("doc") == F.col("rep"), "left_semi").dropDuplicates(["doc", "n"])
    need = F.expr(f"(n - ceil({percent} * n / 100)) div 2 + 1").alias("need")
    once = _sieve(reps.filter("n > 0").select("doc", need, "head"))
    discard(heads)
    sieved = _sieve(once)
    discard(once)
    passed = join_sized(body, sieved.select(F.col("doc").alias("rep")).distinct(), F.col("doc") == F.col("rep"), "left_semi")
    sets = passed.mapInArrow(_digest(words, percent, True), f"doc {kind}, tokens array<long>").dropDuplicates(["doc"])
    sets = durable(sets, "tokens")
    links = find_links(sets, percent)
    discard(sets)
    linked = components(links, "a", "b").withColumnRenamed("node", "rep")
    named = join_sized(classes, linked, "rep", "left").filter("copies > 1 OR component IS NOT NULL")
    named = durable(named.select(*[F.col(c).alias(f"__{c}") for c in whole], F.coalesce("component", "rep").alias("__component")), "named")
    same = (F.col("n") == F.col("__n")) & (F.col("print1") == F.col("__print1")) & (F.col("print2") == F.col("__print2"))
    out = join_sized(digest, named, same, "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("__component", "doc").alias("component_id"))
