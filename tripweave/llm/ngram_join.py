"""Exact n-gram Jaccard join: documents in groups, a token-group matrix, and opened groups.

A document is the set of its distinct shingles of ``words`` words (three unless said otherwise). Documents with equal sets are one class from
the start. Classes are partitioned into groups of similar ones, whether or not they link: each of three
min-hashes names a leader among the classes of about one size, the most central one, and a class follows
the leader that is offered to most. So the noisy copies of one text make few groups, however many they are. The
token-group matrix holds, per token, each group whose members have it among their first tokens, with the
range of their set sizes.

A class meets another group only through the matrix. All sets are ordered by one global order, shingles
whose rarest word is rarest first; of two sets that link, the first ``n - ceil(p n) + k`` tokens of
both share at least ``k``, here the share ``1 - p`` of the set and three. So the overlap of a class with a
group is bounded by the tokens they share in the matrix, and a group that shares fewer, or has no member of
a fitting size, stays closed.

Members of opened groups, the class's own included, are compared by their differences from the leader, not
by the hundreds of tokens that a group of near copies has in common: the two differ by what only one of the
differences holds. A class that is near the leader is linked with it and asks no further, for what is near
too is connected already. Any other must share part of its difference with a member's, so the rarest tokens
of both differences are joined, as far as the tokens after those still suffice for a link, and what meets is
counted on whole differences, which is exact. Components
are found by passing smallest labels along links, with pointer jumps, until nothing changes.

Word rarity is a table of log counts in hashed buckets, whose size is a parameter; it only orders
tokens. No set of a document without a candidate leaves its task.

Defined cases: null and empty texts have no shingles and link with nothing; texts of fewer words than
a shingle have one; a repeated row is another member of its class; a null id is ignored as component id
unless the component has no other; equal ids with different texts are different documents. Set members
are 58-bit hashes with their rarity, so equality holds but for chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tripweave.llm import text_blocks
from tripweave.llm.storage import stored
from tripweave.session import broadcast_if_small

PERCENT = 90
WORDS = 3
LEAST_SHARED = 3  # tokens that the ordered starts of two linked sets share, besides a tenth of them
RARITY_BUCKETS = 1 << 22
BLOCK_BYTES = 1 << 18  # text whose sets a worker makes at once
_LOWER = text_blocks.lower_ascii()

PROFILE = "struct<n:bigint,node:bigint,keys:array<bigint>,tokens:array<bigint>>"
_PROFILE = pa.struct(
    [
        ("n", pa.int64()),
        ("node", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("tokens", pa.list_(pa.int64())),
    ]
)


def _hasher() -> text_blocks.Hasher:
    return text_blocks.Hasher(seed=11, fold=_LOWER)


def word_rarity(df: DataFrame, text: Column, buckets: int = RARITY_BUCKETS) -> np.ndarray:
    """Log2 of the occurrences of the words of each bucket over all texts (at most ``buckets`` rows)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in text_blocks.blocks(batch.column(0), BLOCK_BYTES):
                starts, ends, _ = block.words(text_blocks.NOT_BLANK)
                ids = hasher.runs(block.data, starts, ends) & np.uint64(buckets - 1)
                # In place: a copy of the table for each worker would count as much as the heap's slack.
                np.add.at(total, ids.astype(np.int64), 1)
        used = np.flatnonzero(total)
        for begin in range(0, len(used), 1 << 16):
            part = used[begin : begin + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "n"]
            )

    counted = (
        df.select(text.alias("text"))
        .mapInArrow(count, "bucket int, n long")
        .groupBy("bucket")
        .agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("rarity"))
        .toArrow()
    )
    table = np.zeros(buckets, np.uint8)
    table[counted["bucket"].to_numpy()] = np.minimum(counted["rarity"].to_numpy(), 63)
    return table


def block_sets(
    block: text_blocks.Block, rarity: np.ndarray, hasher: text_blocks.Hasher, words: int = WORDS
):
    """Ordered tokens of all texts of a block, and each text's range of them.

    A token is the rarity of its rarest word in the upper 6 bits and 58 bits of the shingle's hash.
    """
    starts, ends, bounds = block.words(text_blocks.NOT_BLANK)
    hashes = hasher.runs(block.data, starts, ends)
    rank = rarity[(hashes & np.uint64(len(rarity) - 1)).astype(np.int64)]
    counts = np.diff(bounds)
    keys, owners = [], []
    for size in range(1, words + 1):
        found = text_blocks.windows(hashes, size, seed=13)
        owner = text_blocks.window_owner(bounds, size, len(found))
        # Shorter windows stand for whole texts of fewer words.
        take = owner >= 0
        if size < words:
            take &= counts[np.maximum(owner, 0)] == size
        at = np.flatnonzero(take)
        lowest = rank[at]
        for step in range(1, size):
            lowest = np.minimum(lowest, rank[at + step])
        keys.append((lowest.astype(np.uint64) << np.uint64(58)) | (found[at] >> np.uint64(6)))
        owners.append(owner[at])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(block.texts + 1))


def set_names(tokens: np.ndarray) -> np.ndarray:
    return text_blocks.mixed(tokens + np.uint64(0x51ED270B35A1F39D))


def _set_nodes(tokens: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The class of each set of a block: a hash of its members' names in any order; null for an empty set."""
    sizes = np.diff(bounds)
    full = sizes > 0
    nodes = np.zeros(len(sizes), np.uint64)
    if full.any():
        sums = np.add.reduceat(set_names(tokens), bounds[:-1][full])
        nodes[full] = text_blocks.mixed(sums + sizes[full].astype(np.uint64))
    return pa.array(nodes.view(np.int64), mask=~full)


def _set_keys(tokens: np.ndarray, bounds: np.ndarray, of: int = 2) -> np.ndarray:
    """Three group keys of each set of a block, each from ``of`` (1 or 2) of three min-hashes; 0 for empty sets."""
    full = np.diff(bounds) > 0
    keys = np.zeros((len(full), 3), np.uint64)
    if full.any():
        low = np.stack(
            [
                np.minimum.reduceat(
                    text_blocks.mixed(tokens ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)),
                    bounds[:-1][full],
                )
                for seed in (1, 2, 3)
            ],
            axis=1,
        )
        keys[full] = low if of == 1 else text_blocks.mixed(low * np.uint64(3) + np.roll(low, 1, axis=1))
    return keys.view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Consecutive values as lists, without an object for each value."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def shared_by_starts(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """Tokens that the starts of two linked sets share if the smaller has ``n`` tokens.

    The longer the starts, the more they share, and the fewer unlinked sets look alike.
    """
    return LEAST_SHARED + n * (100 - percent) // 100


def start_length(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """Tokens at the start of a set of size ``n``: those it may lack of a linked one, and the shared."""
    needed = -(-percent * n // 100)
    return np.minimum(n, n - needed + shared_by_starts(n, percent))


def _shared_at_least(n: Column, percent: int) -> Column:
    """What the start of a set of ``n`` tokens shares with that of any linked set, even a smaller one."""
    smaller = F.floor(n * percent / F.lit(100))
    return LEAST_SHARED + F.floor(smaller * (100 - percent) / F.lit(100))


def smallest_linkable(percent: int = PERCENT) -> int:
    """Sets below this size link with equal sets only."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def profiles(
    text: Column, rarity: np.ndarray, percent: int = PERCENT, words: int = WORDS
) -> Column:
    """Struct of set size, class (a hash of the set), group keys and first tokens."""
    least = smallest_linkable(percent)

    @arrow_udf(PROFILE)
    def profile(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = _hasher()
        for batch in batches:
            parts = [pa.array([], _PROFILE)]
            for block in text_blocks.blocks(batch, BLOCK_BYTES):
                tokens, bounds = block_sets(block, rarity, hasher, words)
                n = np.diff(bounds)
                grouped = n >= least
                lengths = np.where(grouped, start_length(n, percent), 0)
                place = np.arange(len(tokens)) - np.repeat(bounds[:-1], n)
                start = tokens.view(np.int64)[place < np.repeat(lengths, n)]
                keys = _set_keys(tokens, bounds, of=1)[grouped].ravel()
                columns = [
                    pa.array(n),
                    _set_nodes(tokens, bounds),
                    _lists(keys, 3 * grouped),
                    _lists(start, lengths),
                ]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(_PROFILE)))
            yield pa.concat_arrays(parts)

    return profile.asNondeterministic()(text)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``links`` (a, b); the label is the component's smallest node."""
    edges = stored(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(links.select("b", "a"))
        .distinct()
    )
    labels = stored(
        edges.groupBy("node").agg(F.min("other").alias("other")).select(
            "node", F.least("node", "other").alias("label")
        )
    )
    while True:
        near = labels.select(F.col("node").alias("other"), F.col("label").alias("seen"))
        best = edges.join(near, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = labels.join(best, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = stored(
            lower.join(jump, "label").select(
                "node", "old", F.least("label", "further").alias("label")
            )
        )
        if labels.where("old != label").isEmpty():
            return labels.select("node", "label")


def _whole_sets(
    df: DataFrame, doc: str, text: str, wanted: DataFrame, rarity: np.ndarray, words: int = WORDS
) -> DataFrame:
    """Whole token sets (node, tokens) of the wanted classes (node, rep), read from one text of each."""
    ids = broadcast_if_small(wanted.select(F.col("rep").alias("__rep")).distinct(), 16)
    nodes = broadcast_if_small(wanted.select("node").distinct(), 16)
    texts = df.select(F.col(doc).alias("__doc"), F.col(text).alias("text")).join(
        ids, F.col("__doc").eqNullSafe(F.col("__rep")), "left_semi"
    )

    @arrow_udf("struct<node:bigint,tokens:array<bigint>>")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = _hasher()
        kind = pa.struct([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])
        for batch in batches:
            parts = [pa.array([], kind)]
            for block in text_blocks.blocks(batch, BLOCK_BYTES):
                found, bounds = block_sets(block, rarity, hasher, words)
                tokens = _lists(found.view(np.int64), np.diff(bounds))
                parts.append(
                    pa.StructArray.from_arrays([_set_nodes(found, bounds), tokens], fields=list(kind))
                )
            yield pa.concat_arrays(parts)

    # The class is made of the set again, so an id that stands for several texts does no harm.
    sets = stored(
        texts.select(whole.asNondeterministic()(F.col("text")).alias("set"))
        .select("set.*")
        .join(nodes, "node", "left_semi")
    )
    repeated = sets.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return sets if repeated.isEmpty() else stored(sets.dropDuplicates(["node"]))


def _bounded(sets: DataFrame, percent: int) -> DataFrame:
    """Sets that may link at all, with the largest set that each can link with (``most``).

    A set of ``n`` tokens of which ``own`` are in no other shares at most ``n - own`` with any, so a
    linked set has at most ``(n - own)(100 + p)/p - n`` tokens. Of two linked sets at least one may meet
    its own size again (``light``).
    """
    shared = F.col("n") - F.col("own")
    most = F.floor(shared * (100 + percent) / F.lit(percent)) - F.col("n")
    return (
        sets.where(100 * shared >= percent * F.col("n"))
        .withColumn("most", most)
        .withColumn("light", most >= F.col("n"))
    )


def _classes(documents: DataFrame) -> DataFrame:
    """One row per set: ``node``, an id that has it (``rep``), size, keys and start.

    Most sets belong to one document, whose row is read where it is stored; only copies are shuffled.
    """
    counted = documents.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = broadcast_if_small(counted.select("node"), 16)
    alone = documents.join(several, "node", "left_anti").select(
        "node", F.col("__doc").alias("rep"), "n", "keys", F.col("tokens").alias("start")
    )
    copies = documents.join(several, "node", "left_semi").groupBy("node").agg(
        F.min("__doc").alias("rep"),
        F.first("n").alias("n"),
        F.first("keys").alias("keys"),
        F.first("tokens").alias("start"),
    )
    return alone.unionByName(stored(copies))


def _candidates(classes: DataFrame, positions: DataFrame, percent: int) -> DataFrame:
    """Classes that share enough of their first tokens with others to link with one.

    ``positions`` has the places (from 0) of the first tokens that some other class has among its first
    tokens. If two linked sets share ``k`` of those, the last of them lies no earlier than a set's
    ``k``-th shared token, so the tokens before that which nobody shares are in no linked set.
    """
    places = positions.groupBy("node").agg(F.sort_array(F.collect_list("at")).alias("places"))
    met = classes.join(places, "node").withColumn("needed", _shared_at_least(F.col("n"), percent))
    met = met.where(F.size("places") >= F.col("needed"))
    last = F.get("places", F.col("needed").cast("int") - 1)
    return _bounded(met.withColumn("own", last - (F.col("needed") - 1)), percent).drop(
        "most", "light"
    )


def _with_privacy(candidates: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The candidates that may link once the tokens that only one of them has are known."""
    own = (
        whole.select("node", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("node"))
        .where("sets = 1")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    exact = candidates.drop("own").join(own, "node", "left")
    return (
        _bounded(exact.withColumn("own", F.coalesce("alone", F.lit(0))), percent)
        .drop("alone")
        .withColumn("length", F.size("start"))
        .withColumn("last", F.element_at("start", -1))
    )


def _named(df: DataFrame, suffix: str, *names: str) -> DataFrame:
    return df.select(*[F.col(name).alias(f"{name}_{suffix}") for name in names])


def _leader_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets with the leader of each group that their keys name, if they look alike.

    The leader is the set with the fewest tokens of its own: the most central of its group. Sizes within a
    group differ by less than those of linked sets, so that differences from a leader stay short. A pair need
    not link: it must share half of what the starts of linked sets share.
    """
    size = F.floor(2 * F.log(F.col("n")) / F.log(F.lit(100 / percent)))
    keyed = sets.select("node", "own", size.alias("size"), F.posexplode("keys").alias("number", "key"))
    group = ["number", "key", "size"]
    leaders = (
        keyed.groupBy(*group)
        .agg(
            F.min(F.struct("own", "node")).alias("first"),
            F.max("node").alias("last"),
            F.min("node").alias("least"),
        )
        .where("last != least")
        .select(*group, F.col("first.node").alias("node_b"))
    )
    pairs = (
        keyed.withColumnRenamed("node", "node_a")
        .join(leaders, group)
        .where("node_a != node_b")
        .select("node_a", "node_b")
        .distinct()
    )
    facts = ("node", "start", "needed")
    joined = pairs.join(_named(sets, "a", *facts), "node_a").join(_named(sets, "b", *facts), "node_b")
    shared = F.size(F.array_intersect("start_a", "start_b"))
    return joined.where(2 * shared >= F.least("needed_a", "needed_b")).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")
    )


def _families(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sets with ``family``, the node of their group's leader, and whether they are alone in it.

    Of its leaders a set follows the one that most sets may follow, unless as many may follow itself.
    """
    pairs = stored(pairs)
    followed = pairs.groupBy(F.col("b").alias("leader")).agg(F.count(F.lit(1)).alias("followers"))
    best = (
        pairs.select(F.col("a").alias("node"), F.col("b").alias("leader"))
        .join(followed, "leader")
        .groupBy("node")
        .agg(F.max(F.struct("followers", "leader")).alias("best"))
    )
    own = followed.select(F.col("leader").alias("node"), F.col("followers").alias("mine"))
    leader = (
        best.join(own, "node", "left")
        .where("mine IS NULL OR best.followers > mine")
        .select("node", "best.leader")
    )
    grouped = (
        sets.drop("keys", "rep")
        .join(leader, "node", "left")
        .withColumn("family", F.coalesce("leader", "node"))
        .drop("leader")
    )
    several = grouped.where("family != node").select(F.col("family").alias("node")).distinct()
    led = several.withColumn("leads", F.lit(True))
    return grouped.join(led, "node", "left").withColumn(
        "single", (F.col("family") == F.col("node")) & F.col("leads").isNull()
    ).drop("leads")


def _opened(grouped: DataFrame, percent: int) -> DataFrame:
    """(node, family): other groups that the token-group matrix does not rule out for a set."""
    # One row per shared token: its place, and how many tokens before it nobody shares.
    kept = [name for name in grouped.columns if name not in ("start", "places")]
    rows = stored(
        grouped.select(*kept, "start", F.posexplode("places").alias("number", "at"))
        .withColumn("token", F.get("start", F.col("at")))
        .withColumn("before", F.col("at") - F.col("number"))
        .drop("start", "number")
    )
    # Of a group of one the matrix has the member itself, whose start bounds the difference.
    matrix = (
        rows.where("light")
        .groupBy("token", F.col("family").alias("other"))
        .agg(
            F.min("n").alias("smallest"),
            F.max("n").alias("largest"),
            F.min("before").alias("least"),
            F.min("own").alias("alone"),
            F.min("needed").alias("fewest"),
            F.min("single").alias("single_b"),
            F.max("at").alias("at_b"),
            F.max("length").alias("length_b"),
            F.max("last").alias("last_b"),
        )
    )
    apart = F.floor((100 - percent) * (F.col("n") + F.col("largest")) / F.lit(100 + percent))
    met = (
        rows.join(matrix, "token")
        .where("family != other AND smallest <= most")
        # Of two light sets that are alone one asks.
        .where(~(F.col("single") & F.col("single_b") & F.col("light")) | (F.col("node") > F.col("other")))
        .where((F.col("before") + F.col("least") <= apart) & (F.col("own") + F.col("alone") <= apart))
        .where(100 * F.col("largest") >= percent * F.col("n"))
        .where(100 * F.col("n") >= percent * F.col("smallest"))
        .groupBy("node", "other")
        .agg(
            F.count(F.lit(1)).alias("shared"),
            F.min(F.least("needed", "fewest")).alias("needed"),
            F.max(apart).alias("apart"),
            F.first("single_b").alias("single_b"),
            F.max("at").alias("to_a"),
            F.max("at_b").alias("to_b"),
            F.first("length").alias("length_a"),
            F.max("length_b").alias("length_b"),
            F.first("last").alias("last_a"),
            F.max("last_b").alias("last_b"),
        )
        .where("shared >= needed")
    )
    # The start that ends first is known whole, the other at least up to the last common token.
    alone = F.when(
        F.col("last_a") <= F.col("last_b"), F.col("length_a") + F.col("to_b") + 1
    ).otherwise(F.col("length_b") + F.col("to_a") + 1) - 2 * F.col("shared")
    fits = ~F.col("single_b") | (alone <= F.col("apart"))
    return met.where(fits).select("node", F.col("other").alias("family"))


def _differences(grouped: DataFrame, opened: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Per set and group: size ``n``, ``difference`` from the leader, and whether they are linked.

    One row for the group of each set, and one for each other group that it opens.
    """
    own = grouped.select("node", "family").withColumn("member", F.lit(True))
    wanted = own.unionByName(opened.withColumn("member", F.lit(False)))
    sets = whole.select("node", "tokens")
    led = whole.select(F.col("node").alias("family"), F.col("tokens").alias("of_leader"))
    compared = wanted.join(sets, "node").join(led, "family")
    shared = F.size(F.array_intersect("tokens", "of_leader"))
    n, n_leader = F.size("tokens"), F.size("of_leader")
    apart = n + n_leader - 2 * shared
    known = compared.select(
        "node",
        "family",
        "member",
        n.alias("n"),
        n_leader.alias("n_leader"),
        apart.alias("apart"),
        (100 * shared >= percent * (n + n_leader - shared)).alias("linked"),
        F.array_union(
            F.array_except("tokens", "of_leader"), F.array_except("of_leader", "tokens")
        ).alias("difference"),
    )
    # A set that differs from the leader by more than any member and a link together meets no member.
    reach = grouped.groupBy("family").agg(F.max("n").alias("largest"))
    return known.join(reach, "family")


def _least_apart(percent: int, n_a: Column, n_b: Column) -> Column:
    """Tokens by which two linked sets of these sizes differ at most."""
    return F.floor((100 - percent) * (n_a + n_b) / F.lit(100 + percent))


def _difference_links(differences: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets that are not near the leader with members of the group, exactly.

    Two sets differ by ``apart_a + apart_b - 2 c`` tokens if their differences share ``c``. The sets that
    ask are further from the leader than a link, which gives a least ``c`` for every member and every
    asking set; of ``s`` tokens that anybody in the group shares, the ``s - c + 1`` rarest of both must meet.
    """
    askers = differences.where("NOT linked AND NOT (member AND node = family)")
    asked = askers.select("family").distinct()
    members = differences.where("member AND node != family").join(asked, "family", "left_semi")
    far = F.max(F.col("apart")).alias("radius")
    reached = askers.join(members.groupBy("family").agg(far), "family").where(
        F.col("apart")
        <= F.col("radius") + _least_apart(percent, F.col("n"), F.col("largest"))
    )
    nearest = _least_apart(percent, F.col("n"), F.col("largest"))
    asking = reached.withColumn("least", F.greatest(F.lit(1), F.col("apart") - nearest)).withColumn(
        "asks", F.lit(True)
    )
    # Twice the tokens shared with a set just beyond the leader's reach; sizes move the reach a little.
    drift = F.ceil((100 - percent) * F.greatest(F.col("n") - F.col("n_leader"), F.lit(0)) / F.lit(100 + percent))
    meeting = members.withColumn(
        "least", F.greatest(F.lit(1), F.ceil((F.col("apart") + 1 - drift) / 2))
    ).withColumn("asks", F.lit(False))
    # Members that are not near the leader are on both sides; of two such one side is enough.
    asking = asking.withColumn("both", F.col("member"))
    meeting = meeting.withColumn("both", ~F.col("linked"))
    names = ("family", "node", "n", "apart", "least", "asks", "both", "difference")
    sides = stored(
        asking.select(*names)
        .unionByName(meeting.select(*names))
        .withColumn("side", F.monotonically_increasing_id())
    )
    # A token counts once for each set.
    counted = (
        sides.select("family", "node", "asks", F.explode("difference").alias("token"))
        .groupBy("family", "token")
        .agg(
            F.min("node").alias("one"),
            F.max("node").alias("other"),
            F.count(F.lit(1)).alias("sets"),
            F.max("asks").alias("asked"),
        )
        .where("one != other AND asked")
        .select("family", "token", "sets")
    )
    common = (
        sides.select("family", "side", F.explode("difference").alias("token"))
        .join(counted, ["family", "token"])
        .groupBy("side")
        .agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("shared"))
    )
    # ``left``: the shared tokens from one on, a bound of what two sets share if it is the first they share.
    prefixes = stored(
        common.join(broadcast_if_small(sides.drop("difference"), 64), "side")
        .where(F.size("shared") >= F.col("least"))
        .select(
            "family",
            "node",
            "asks",
            "both",
            "n",
            "apart",
            F.size("shared").alias("common"),
            F.posexplode(
                F.slice("shared", F.lit(1), (F.size("shared") - F.col("least") + 1).cast("int"))
            ).alias("at", "first"),
        )
        .withColumn("left", F.col("common") - F.col("at"))
        .withColumn("token", F.col("first.token"))
        .drop("common", "at", "first")
    )
    bounds = ("node", "both", "n", "apart", "left")
    certain = F.col("apart_a") + F.col("apart_b") - 2 * F.least("left_a", "left_b")
    pairs = (
        _named(prefixes.where("asks"), "a", *bounds, "family", "token")
        .join(
            _named(prefixes.where("NOT asks"), "b", *bounds, "family", "token"),
            (F.col("family_a") == F.col("family_b")) & (F.col("token_a") == F.col("token_b")),
        )
        .where("node_a != node_b AND (NOT (both_a AND both_b) OR node_a > node_b)")
        .where(certain <= _least_apart(percent, F.col("n_a"), F.col("n_b")))
        .select(F.col("family_a").alias("family"), F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )
    facts = [F.col(name) for name in ("n", "apart", "difference")]
    first = sides.where("asks").select("family", F.col("node").alias("a"), F.struct(*facts).alias("of_a"))
    second = sides.where("NOT asks").select("family", F.col("node").alias("b"), F.struct(*facts).alias("of_b"))
    both = pairs.join(first, ["family", "a"]).join(second, ["family", "b"])
    common = F.size(F.array_intersect("of_a.difference", "of_b.difference"))
    apart = F.col("of_a.apart") + F.col("of_b.apart") - 2 * common
    limit = _least_apart(percent, F.col("of_a.n"), F.col("of_b.n"))
    return both.where(apart <= limit).select("a", "b")


def find_components(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    words: int = WORDS,
) -> DataFrame:
    """One row per row of ``df``: id, ``text_hash``, ``n_shingles``, ``component`` and ``component_id``.

    ``component`` is a key of the component (null for documents without words), ``component_id`` the
    smallest id in it.
    """
    rarity = word_rarity(df, F.col(text))
    documents = stored(
        df.select(
            F.col(doc).alias("__doc"),
            F.unhex(F.md5(text)).alias("text_hash"),
            profiles(F.col(text), rarity, percent, words).alias("profile"),
        ).select("__doc", "text_hash", "profile.*")
    )
    least = smallest_linkable(percent)
    classes = _classes(documents.where(F.col("n") >= least))
    rows = classes.select("node", F.posexplode("start").alias("at", "token"))
    shared = (
        rows.groupBy("token")
        .agg(F.count(F.lit(1)).alias("classes"))
        .where("classes > 1")
        .select("token")
    )
    positions = stored(rows.join(broadcast_if_small(shared, 8), "token"))
    candidates = stored(_candidates(classes, positions, percent))
    whole = _whole_sets(df, doc, text, candidates.select("node", "rep"), rarity, words)
    sets = stored(_with_privacy(candidates, whole, percent))

    grouped = stored(_families(sets, _leader_pairs(sets, percent)))
    opened = _opened(grouped, percent)
    differences = stored(_differences(grouped, opened, whole, percent))
    near = differences.where("linked AND node != family").select(
        F.col("node").alias("a"), F.col("family").alias("b")
    )
    labels = components(near.union(_difference_links(differences, percent)))
    placed = documents.select("__doc", "text_hash", "n", "node").join(labels, "node", "left")
    placed = placed.withColumn("component", F.coalesce("label", "node"))
    first = (
        placed.where("component IS NOT NULL")
        .groupBy("component")
        .agg(F.min("__doc").alias("component_id"))
    )
    return placed.join(first, "component", "left").select(
        F.col("__doc").alias(doc),
        "text_hash",
        F.col("n").alias("n_shingles"),
        "component",
        F.when(F.col("component").isNull(), F.col("__doc"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
    )


def keep_one_of_each(
    df: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    words: int = WORDS,
) -> DataFrame:
    """The rows of ``df`` without those that link, directly or not, with one that stays.

    Of a component the row with the smallest id stays (null first), of equal ids the one with the
    smallest text hash, of equal rows one. Rows without words all stay.
    """
    found = stored(find_components(df, doc, text, percent, words))
    place = F.struct(F.col(doc).alias("id"), "text_hash")
    first = (
        found.where("component IS NOT NULL")
        .groupBy("component")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows"))
        .select("first.*", "rows")
    )
    keys = broadcast_if_small(
        first.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "rows"), 48
    )
    empty = F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]", 2)) < 2
    # The whole row in one column, so that no column of the table clashes with those added here.
    packed = df.select(
        F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row"),
        F.col(doc).alias("id"),
        F.unhex(F.md5(text)).alias("hash"),
        empty.alias("empty"),
    )
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))
    held = packed.where("NOT empty").join(keys, same)
    # Only documents of several rows can repeat; the others need no shuffle.
    single = held.where("rows = 1").select("row.*")
    several = held.where("rows > 1").dropDuplicates(["__id", "__hash"]).select("row.*")
    return single.union(several).union(packed.where("empty").select("row.*"))
