"""Repair of conversation structure by error-correcting parsing of roles."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, settle_table, table
from .earley import EMPTY, FULL, NAMES, OTHER, A, Chart, Costs, S, U, applied, chain, repair, symbol
from .sharding import _crc_step

_WS = " \t\n\x0b\x0c\r"
_INITIALS = {"s": S, "u": U, "a": A}
_LEGAL = {(S, U), (U, A), (A, U)}
CHUNK = 4 << 20
_ENDS = "conv_id long, part int, first int, final int, items array<long>"
_PLAN = "conv_id long, part int, entry int, exit int, added string, prior int"
_PARTS = "conv_id long, part int, seq int, whole boolean, cost long, blank long, duplicate long, truncated long, illegal long, audit string, repaired_sha256 string, piece binary"
_JOINED = "conv_id long, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows(batch):
    """(conversation, role number, fault, copies, role, text) of the rows of a batch."""
    roles = [_INITIALS.get(r[:1], OTHER) for r in batch["role"].to_pylist()]
    return zip(batch["conv_id"].to_pylist(), roles, batch["fault"].to_pylist(), batch["n"].to_pylist(), batch["role"].to_pylist(), batch["text"], strict=True)


def _symbols(role: int, fault: str, n: int) -> list[tuple[int, int]]:
    """A row and its copies: all but the first are duplicates, unless all are blank or repeat an earlier row."""
    if fault in ("blank", "duplicate"):
        return [(symbol(role, True, False), n)]
    return [(symbol(role, False, fault == "truncated"), 1), *([(symbol(role, True, False), n - 1)] if n > 1 else [])]


def _runs(batches):
    """The rows of one conversation after another, as a partition holds them: (conversation, rows)."""
    at, held = None, None
    for batch in batches:
        for conv, *row in _rows(batch):
            if held is None or conv != at:
                if held:
                    yield at, held
                at, held = conv, []
            held.append(row)
    if held:
        yield at, held


def _ends(costs: Costs):
    """What the first and the last conversation of a partition come to from every item of the grammar: others lie in no other partition."""

    def run(batches):
        from pyspark import TaskContext

        part, out, runs = TaskContext.get().partitionId(), [], _runs(batches)

        def told(conv, rows):
            chart = Chart([s for role, fault, n, *_ in rows for s in _symbols(role, fault, n)], costs, range(FULL + 1), keep_back=False)
            items = [v for (e, x), (cost, rank) in chart.last.items() for v in (e, x, cost, rank)]
            out.append((conv, part, rows[0][0], rows[-1][0], items))

        first = next(runs, None)
        if first:
            told(*first)
            last = None
            for last in runs:  # noqa: B007  only the last counts
                pass
            if last:
                told(*last)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv_id", "part", "first", "final", "items"])

    return run


def _joined_ends(costs: Costs):
    """Which items a conversation passes at the ends of its partitions, when it lies in several."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t, out = t.sort_values("part"), []
        if len(t) > 1:
            column, came, prior = {EMPTY: (0, 0)}, [], -1
            for items in t["items"]:
                i = [int(x) for x in items]
                column, how = chain(column, {(i[k], i[k + 1]): (i[k + 2], i[k + 3]) for k in range(0, len(i), 4)})
                came.append(how)
            chart = Chart([], costs)
            chart.last = {(EMPTY, x): v for x, v in column.items()}
            _, at, added = chart.accepted()
            for k in range(len(t) - 1, -1, -1):
                entry = came[k][at]
                prior = int(t["final"].iloc[k - 1]) if k else -1
                out.append((t["conv_id"].iloc[k], int(t["part"].iloc[k]), entry, at, added, prior))
                at, added = entry, ""
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PLAN.split(", ")]).astype({"conv_id": "Int64"})

    return run


def _repaired(costs: Costs):
    def run(batches):
        from pyspark import TaskContext

        part, names, kinds = TaskContext.get().partitionId(), [c.split()[0] for c in _PARTS.split(", ")], (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.binary())
        record = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
        plans: dict = {}

        def noted(batches):
            for batch in batches:
                for conv, entry, exit_, added, prior in set(zip(*(batch[c].to_pylist() for c in ("conv_id", "entry", "exit", "added", "prior")), strict=True)):
                    if entry is not None:
                        plans[conv] = (entry, exit_, added, prior)
                yield batch

        out, size = [], 0
        for conv, rows in _runs(noted(batches)):
            symbols, lines = [], []
            faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
            plan = plans.get(conv)
            illegal, before = 0, plan[3] if plan else -1
            for role, fault, n, name, text in rows:
                illegal += (before >= 0 and (before, role) not in _LEGAL) + n - 1
                before = role
                own = _symbols(role, fault, n)
                symbols += own
                lines += [(name, text.as_py())] * len(own)
                if fault in ("blank", "duplicate"):
                    faults[fault] += n
                else:
                    faults["truncated"] += fault == "truncated"
                    faults["duplicate"] += n - 1
            if plan:
                entry, end, added, _ = plan
                chart = Chart(symbols, costs, (entry,))
                cost, edits = chart.last[entry, end][0] + costs.insert * len(added), chart.edits(entry, end, added)
            else:
                cost, edits = repair(symbols, costs)
            audit, kept = applied(edits, symbols, lines, plan[0] if plan else EMPTY)
            counts = (cost, *faults.values(), illegal, audit)
            text = "\n".join(kept).encode()
            if plan:
                pieces = [b"\n".join((b"", text))[0 if kept else 1 :][i : i + CHUNK] for i in range(0, max(1, len(text) + bool(kept)), CHUNK)]
                out += [(conv, part, seq, False, *(counts if not seq else [None] * 6), None, piece) for seq, piece in enumerate(pieces)]
                size += len(text)
            else:
                out.append((conv, part, 0, True, *counts, hashlib.sha256(text).hexdigest(), None))
            if len(out) >= 10_000 or size >= CHUNK:
                yield record(out)
                out, size = [], 0
        if out:
            yield record(out)

    return run


def _digests(batches):
    """Audit and digest of conversations whose parts come in order; no more than a batch of them is held."""
    at, begun, audit, sha, out = None, False, [], None, []
    done = lambda: out.append((at, "".join(audit), sha[0].hexdigest()))
    record = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["conv_id", "audit", "repaired_sha256"])
    for batch in batches:
        for conv, more, piece in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "piece")), strict=True):
            if not begun or conv != at:
                if begun:
                    done()
                at, begun, audit, sha, wrote = conv, True, [], [hashlib.sha256()], False
            audit.append(more or "")
            if piece:  # every part with lines begins with a line feed; the first of all has none
                sha[0].update(piece if wrote else piece[1:])
                wrote = True
    if begun:
        done()
    yield record()


def repair_conversations(rows: DataFrame, costs: Costs | None = None, n_col: str | None = None) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``rows`` (``conv_id, turn, role, text``).

    Returns per conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. A
    null text or role is one space, a null turn comes first, a null conv_id is a conversation like others.
    Rows of one turn follow in the order of role and of a digest of both; equal rows are one row with a
    count (``n_col`` may hold more). A role counts by its initial, one that is none of s, u, a is in no grammar;
    a row with an empty text is blank. Other columns are ignored, whatever their names. Without rows there is no result.

    Rows are range-partitioned in the order of conversation and turn, so one with a third of all rows
    lies in many partitions. For the conversations at both ends of each partition a first pass tells what their rows
    come to from each of the four items; those tables, two a partition, are chained for each conversation, and a second
    pass repairs each part with its items given. A task holds the rows of one conversation in its partition.
    The digest of the repaired text of a conversation over several partitions has to be taken in
    order: one task reads its parts as a stream of pieces. A very long text is held by one task at a time.
    """
    costs = costs or Costs()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.col(n_col).cast("long") if n_col else F.lit(1).cast("long")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), n.alias("n"))
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("b"), "turn")
    own = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    key = F.concat(space("conv_id"), F.lit(":"), own)
    same = settle_table(same.withColumn("key", key), "conversations")
    # Texts that a conversation has at several turns: the first of them.
    several = settle(same.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    hot = F.col("m") > max(1000, same.count() // 10_000)  # 10,000 such groups at most
    marked = same.join(F.broadcast(several.where(hot).select("key", F.col("first").alias("hot"))), "key", "left")
    # Their rows look for no other group: they are dealt by turn.
    marked = marked.withColumn("key", F.when(F.col("hot").isNotNull(), F.concat("key", F.lit("+"), F.coalesce(F.col("turn").cast("string"), F.lit("")))).otherwise(F.col("key")))
    marked = marked.join(several.where(~hot).select("key", F.col("first").alias("cold")), "key", "left")
    first, solid = F.coalesce("hot", "cold"), F.rtrim(F.col("text"), F.lit(_WS))
    fault = F.when(solid == "", "blank").when(first.isNotNull() & (place > first), "duplicate").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("own")]
    placed = marked.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), own.alias("own")).repartitionByRange(*order).sortWithinPartitions(*order).drop("own", "turn")
    placed = settle(placed)
    plan = settle(placed.mapInArrow(_ends(costs), _ENDS).groupBy("conv_id").applyInPandas(_joined_ends(costs), _PLAN))
    # At most two rows for each partition.
    guided = placed.withColumn("part", F.spark_partition_id()).alias("r").join(F.broadcast(plan.alias("p")), F.expr("r.conv_id <=> p.conv_id AND r.part = p.part"), "left")
    guided = guided.select("r.conv_id", "r.role", "r.text", "r.n", "r.fault", "p.entry", "p.exit", "p.added", "p.prior")
    parts = settle(guided.mapInArrow(_repaired(costs), _PARTS))
    counts = ("cost", "blank", "duplicate", "truncated", "illegal")
    whole = parts.where("whole").select("conv_id", *counts, "audit", "repaired_sha256")
    split = parts.where("NOT whole")
    ordered = split.select("conv_id", "part", "seq", "audit", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    digests = ordered.mapInArrow(_digests, _JOINED)
    turns = same.groupBy("conv_id").agg(F.coalesce(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count_distinct("turn")), F.lit(0)).alias("gaps"))
    sums = split.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in counts))
    found = turns
    for part in (whole, sums, digests):
        found = found.unionByName(part, allowMissingColumns=True)
    return found.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in (*COUNTS, "audit", "repaired_sha256")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 is left out, 1 has an empty text, 2 loses
    its full stops, exclamation and question marks, 3 stands twice (``n``), 4 has the role user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit(NAMES[U])).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"),
    )


def op11_conversation_repair(spark, sf_dir):
    """Repairs of the damaged ``conversations``; those without rows after the damage have zeros and an empty repair."""
    conversations = table(spark, sf_dir, "conversations")
    found = repair_conversations(damaged(conversations), n_col="n")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = found.unionByName(ids, allowMissingColumns=True).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in found.columns[1:]))
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return out.select("conv_id", *(F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]))


def _sql() -> str:
    crc = f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, ({[_crc_step(i) for i in range(256)]})[xor(a, x) % 256 + 1])))"
    plus = lambda v, c, edit: f"(lpad(CAST(CAST(left({v}, 7) AS INT) + {c} AS VARCHAR), 7, '0') || substr({v}, 8) || '{edit}')"
    least = lambda *v: f"least({', '.join(v)})"
    insert = lambda *names: ", ".join(plus(n, 5, "I") for n in names)
    live = lambda new, old: f"CASE WHEN dead THEN {plus(old, 2, 'D')} ELSE least({plus(old, 2, 'D')}, {new}) END"
    way = lambda kind, *names: ", ".join(f"CASE WHEN kind = '{kind}' THEN {plus(n, 'more', 'K')} ELSE {plus(n, '(1 + more)', 'R')} END" for n in names)
    system = f"CASE WHEN kind = 's' THEN {plus('e', 'more', 'K')} ELSE '9000000' END"
    # An insertion comes before the row: first one that opens a pair, then one that closes it, then one more.
    closed = f"""SELECT conv_id, i, n, e, s, h2 AS h, f2 AS f FROM (SELECT *, {least('h1', insert('f2'))} AS h2 FROM (SELECT *, {least('f', insert('h1'))} AS f2 FROM (SELECT *, {least('h', insert('e', 's', 'f'))} AS h1 FROM p)))"""
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
      c AS (SELECT *, {crc} % 20 AS c FROM k),
      d AS (SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE c <> 0),
      o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS kind, lag(left(role, 1)) OVER w AS prior, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
      r AS MATERIALIZED (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
      p AS (SELECT DISTINCT conv_id, 1::BIGINT AS i, n, '0000000' AS e, '9000000' AS s, '9000000' AS h, '9000000' AS f FROM r
        UNION ALL SELECT conv_id, i + 1, n, {plus('e', 2, 'D')}, {live(system, 's')}, {live(way('u', 'e', 's', 'f'), 'h')}, {live(way('a', 'h'), 'f')}
        FROM (SELECT z.*, r.kind, r.fault IN ('blank', 'duplicate') AS dead, CASE r.fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM ({closed}) z JOIN r ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.i = z.i WHERE z.i <= z.n)),
      b AS (SELECT conv_id, CAST(left(v, 7) AS BIGINT) AS cost, substr(v, 8) AS audit FROM (SELECT conv_id, least(e, f) AS v FROM ({closed}) WHERE i = n + 1)),
      l AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, audit FROM b),
      m AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, j - length(regexp_replace(left(audit, j), '[^I]', '', 'g')) AS i, length(regexp_replace(left(audit, j), 'D', '', 'g')) AS place FROM l),
      x AS (SELECT m.*, r.role, r.text, bool_or(edit = 'K' AND place = 1 AND r.kind = 's') OVER (PARTITION BY m.conv_id) AS led FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i AND edit <> 'I' WHERE edit <> 'D'),
      y AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired FROM x GROUP BY conv_id),
      g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND prior || kind NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
      SELECT q.conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in COUNTS)}, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM q.conv_id"""


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL = {"op11_conversation_repair": _sql()}
