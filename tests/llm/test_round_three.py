"""Conversation repair, token files and centroid clustering against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugemill.llm import centroids, conversation, earley, embedding_dedup, exact_dedup, mixing, ngram_join, quality, registry, simple8b, token_files
from gaugemill.llm.common import fresh_path, table

rng = random.Random(11)


# --- op11 ------------------------------------------------------------------------------------------------------


def enumerated(rows, costs):
    """Least (cost, audit) and its roles over every way to edit a few rows, with up to two insertions at each place."""
    best, gaps = None, ["", "u", "a", "ua", "au"]
    ways = []
    for role, dead, cut in rows:
        more = costs.truncated * cut
        ways.append([("D", costs.delete, "")] + ([] if dead else [("K", more, "suax"[role]), ("R", costs.rerole + more, "u"), ("R", costs.rerole + more, "a")]))
    for chosen in itertools.product(*ways):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            roles = "".join(g + c[2] for g, c in zip(between, chosen, strict=False)) + between[-1]
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(c[1] for c in chosen) + costs.insert * sum(map(len, between))
                audit = "".join("I" * len(g) + c[0] for g, c in zip(between, chosen, strict=False)) + "I" * len(between[-1])
                best = min(best or (cost, audit, roles), (cost, audit, roles))
    return best


COSTS = [earley.Costs(), earley.Costs(3, 4, 1, 2), earley.Costs(1, 3, 1, 0), earley.Costs(2, 2, 2, 2), earley.Costs(0, 0, 1, 0)]


@pytest.mark.parametrize("costs", COSTS)
def test_parser_against_all_edits(costs):
    for _ in range(30):
        rows = [(rng.choice([0, 1, 1, 2, 2, 3]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 3))]
        symbols = [(earley.symbol(*r), 1) for r in rows]
        cost, edits = earley.repair(symbols, costs)
        audit, lines = earley.applied(edits, symbols, [({0: "s", 1: "u", 2: "a", 3: "x"}[r[0]], "t") for r in rows])
        assert (cost, audit, "".join(x[0] for x in lines)) == enumerated(rows, costs), rows


def by_strings(rows, costs):
    """Least (cost, audit) by carrying whole strings from row to row."""
    allowed = {"e": {"s": "s", "u": "h"}, "s": {"u": "h"}, "h": {"a": "f"}, "f": {"u": "h"}}

    def inserted(col):
        for _ in range(6):
            for x, (c, a) in list(col.items()):
                for role, y in allowed[x].items():
                    if role != "s":
                        new = (c + costs.insert, a + "I")
                        col[y] = min(col.get(y, new), new)
        return col

    col = {"e": (0, "")}
    for role, dead, cut in rows:
        new = {}
        for x, (c, a) in inserted(col).items():
            ways = [(x, c + costs.delete, "D")]
            if not dead:
                for wanted, y in allowed[x].items():
                    if "suax"[role] == wanted:
                        ways.append((y, c + costs.truncated * cut, "K"))
                    if wanted != "s":
                        ways.append((y, c + costs.rerole + costs.truncated * cut, "R"))
            for y, cost, edit in ways:
                new[y] = min(new.get(y, (cost, a + edit)), (cost, a + edit))
        col = new
    return min(v for x, v in inserted(col).items() if x in "ef")


@pytest.mark.parametrize("costs", COSTS)
def test_long_sequences_and_chained_segments(costs):
    for _ in range(10):
        rows = [(rng.choice([0, 1, 1, 1, 2, 2, 3]), rng.random() < 0.1, rng.random() < 0.1) for _ in range(60)]
        symbols = [(earley.symbol(*r), 1) for r in rows]
        cost, edits = earley.repair(symbols, costs)
        whole = "".join(w for w, _ in edits)
        assert (cost, whole) == by_strings(rows, costs)
        cuts = [0, *sorted(rng.sample(range(1, 60), 3)), 60]
        column, came = {earley.EMPTY: (0, 0)}, []
        for a, b in itertools.pairwise(cuts):
            column, how = earley.chain(column, earley.Chart(symbols[a:b], costs, range(4), keep_back=False).last)
            came.append(how)
        chart = earley.Chart([], costs)
        chart.last = {(earley.EMPTY, x): v for x, v in column.items()}
        total, at, added = chart.accepted()
        audit = ""
        for k in range(3, -1, -1):
            own = earley.Chart(symbols[cuts[k] : cuts[k + 1]], costs, (came[k][at],))
            audit, at, added = "".join(w for w, _ in own.edits(came[k][at], at, added)) + audit, came[k][at], ""
        assert (total, audit) == (cost, whole)


def brute_conversations(rows):
    """What the contract says, one conversation at a time; rows are (conv_id, turn, role, text) with equal rows repeated."""
    out, costs, own = {}, earley.Costs(), {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
        own.setdefault(conv, []).append((turn is not None, turn or 0, role, digest, text))
    for conv, mine in own.items():
        mine.sort()
        seen, faults, symbols, lines = set(), [], [], []
        for _, _, role, _, text in mine:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            symbols.append(("suax".index(role[:1]) if role[:1] in tuple("sua") else 3, fault in ("blank", "duplicate"), fault == "truncated"))
            lines.append((role, text))
        cost, audit = by_strings(symbols, costs)
        kept, k = [], 0
        for edit in audit:
            if edit in "KR":
                kept.append((lines[k][0] if edit == "K" else "user" if not kept or kept[-1][0][0] in "sa" else "assistant", lines[k][1]))
            elif edit == "I":
                kept.append(("user" if not kept or kept[-1][0][0] in "sa" else "assistant", ""))
            k += edit != "I"
        turns = [t for b, t, *_ in mine if b]
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(":".join(x) for x in kept).encode()).hexdigest())
    return out


def conversations(n_long=150):
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"], ["Yes.", "No!", "Cut off", "", " \t\n", None, "Why? \n", "Same.", "été?", "a\x00b."]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in [1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, None, None, None] for _ in range(2)]
    rows += [(9, None if i % 50 == 7 else i // 2 * 2 + (i % 3 == 0), ["user", "assistant"][i % 2] if rng.random() < 0.8 else rng.choice(roles), rng.choice([*texts, *[f"text {i}."] * 9])) for i in range(n_long)]
    return [*rows, *rows[:3], rows[-1], rows[-1], (7, 1, "user", "word " * 200_000 + "."), (7, 2, "assistant", "Done.")]


@pytest.mark.parametrize("partitions", [1, 23])
def test_conversations_against_brute_force(spark, partitions):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, key string, n long, part int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # one conversation lies in many partitions
    try:
        found = {r[0]: tuple(r[1:]) for r in conversation.repair_conversations(df).collect()}
        assert found == brute_conversations(rows)
        assert conversation.repair_conversations(df.limit(0)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (1, None) for t in [*range(60), None]]
    found = [tuple(r) for r in conversation.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            want.append((c, t, "user" if k == 4 else role, "" if k == 1 else "One Two" if k == 2 else text, 2 if k == 3 else 1))
    assert sorted(found, key=repr) == sorted(want, key=repr)


# --- op12 ------------------------------------------------------------------------------------------------------


def test_simple8b_round_trip():
    g = np.random.default_rng(3)
    for kind in range(6):
        for _ in range(12):
            n = int(g.integers(0, 2500))
            v = [
                g.integers(0, 1 << 64, n, dtype=np.uint64) >> g.integers(0, 64, n).astype(np.uint64), g.integers(0, 50_000, n), g.integers(0, 2, n).astype(np.uint64) * np.uint64(1 << 63),
                np.zeros(n), g.integers(1 << 60, 1 << 64, n, dtype=np.uint64), (g.random(n) < 0.003) * 70_000,
            ][kind].astype(np.uint64)
            block = int(g.choice([1, 7, 128, 512]))
            words, n_words = simple8b.encode_blocks(v, block)
            n_values = np.minimum(block, n - block * np.arange(len(n_words)))
            assert (simple8b.decode_blocks(words, n_words, n_values) == v).all()
            if len(n_words) > 2:  # a block by itself
                a = int(n_words[:1].sum())
                assert (simple8b.decode_blocks(words[a : a + n_words[1]], n_words[1:2], n_values[1:2]) == v[block : 2 * block]).all()
    words, _ = simple8b.encode_blocks(np.zeros(480, np.uint64), 480)
    assert len(words) == 2
    with pytest.raises(ValueError):
        simple8b.decode_blocks(words, np.array([2]), np.array([481]))


TEXTS = ["It's THE end, isn't it?", "a1b22 3.4", "", None, "  \t\n ", "<|endoftext|>x<|startoftext|> |", "ÉTÉ straße ×÷ naïve", "é ́x Ångström", "你好。world wide web\u0085x", "İstanbul ΣΣ ﬁn", "x" * 5000, "don't " * 9, "(é.)!? '' ''s", "tab\x1fsep \x00nul", "\U0001f600 ok​ok", "mail a.b@c.org http://x.y/?q=1&r=2", "ªºµ ²½", "word " * 50_000]


def test_encoder_gives_the_ids_of_whole_texts(spark, sf_dir):
    e = token_files.Encoder(token_files.tokenizer_path())
    assert e.plain
    given = TEXTS + [r.text for r in table(spark, sf_dir, "documents").select("text").collect()]
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in given], add_special_tokens=False)]
    for plain in (True, False, True):  # the third time from what is remembered
        e.plain = plain
        ids, counts = e(pa.array(given))
        assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    e = token_files.Encoder(token_files.tokenizer_path())
    for _ in range(2):
        ids, _ = e(pa.array(TEXTS))
        assert ids.tolist() == [i for x in e.tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False) for i in x.ids]
        assert len(e.known) <= 5 and len(e.older) <= 5


def test_token_files_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    rows = [(i * 7 % 19, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (3, "twice", "x", 1), (3, "twice", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, place int")
    path = fresh_path(spark, "test-ids")
    files = token_files.write_tokens(df, path)
    got = [tuple(r) for r in token_files.with_starts(token_files.read_tokens(files, path), files).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    t, want, start = Tokenizer.from_file(token_files.tokenizer_path()), [], 0
    for doc, text in sorted(((d, x or "") for d, x, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()))):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    empty = token_files.write_tokens(df.limit(0), path)
    assert token_files.with_starts(token_files.read_tokens(empty, path), empty).count() == 0
    bare = token_files.write_tokens(df, fresh_path(spark, "test-bare"), end_id=None)  # documents without any id
    assert sorted(r.n_tokens for r in token_files.read_tokens(bare, path).collect()) == sorted(n - 1 for _, _, n, _ in want)


def test_files_of_many_blocks(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(token_files, "BLOCK", 16)
    monkeypatch.setattr(token_files, "RUN_BLOCKS", 4)
    g = np.random.default_rng(5)
    counts = np.array([0, 0, 3, 1, 200, 0, 64, 15, 1, 0])
    ids = g.integers(0, 50_000, counts.sum()).astype(np.uint32)
    local = fs.LocalFileSystem()
    w = token_files.Writer(local.open_output_stream(str(tmp_path / "x")))
    w.add([None, *range(1, 5)], ids[:204], counts[:5])
    w.add(list(range(5, 10)), ids[204:], counts[5:])
    w.close()
    w.out.close()
    with local.open_input_file(str(tmp_path / "x")) as f:
        r = token_files.Reader(f)
        rows = [x for b in token_files._documents("x", r) for x in b.to_pylist()]
        ends = np.cumsum(counts)
        assert [x["doc_id"] for x in rows] == [None, *range(1, 10)] and [x["n_tokens"] for x in rows] == counts.tolist()
        for k, x in enumerate(rows):
            own = ids[ends[k] - counts[k] : ends[k]]
            assert x["ids_crc32"] == zlib.crc32(own.astype("<u4").tobytes()) and r.document(k).tolist() == own.tolist()


# --- op13 ------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale=1024):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    name = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    cent = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), np.array(r[1], "<i8").tobytes()))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        to = [min(range(len(cent)), key=lambda c: (dist(v, cent[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(cent)):
                mine = [v for (_, v), t in zip(kept, to, strict=True) if t == c]
                if mine:
                    cent[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, t, dist(v, cent[t])) for (i, v), t in zip(kept, to, strict=True)), key=repr), cent


@pytest.mark.parametrize("k,spread", [(8, 1.0), (8, 0.01), (40, 1.0), (3, 0.002), (1, 1.0)])
def test_clusters_against_brute_force(spark, k, spread):
    g = np.random.default_rng(k)
    rows = [(i, (spread * g.normal(size=4).round(3)).tolist()) for i in range(250)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(60)]  # copies and ties
    rows += [(2000, None), (2001, [0.0] * 3), (2002, [0.0, None, 1.0, 1.0]), (2003, [float("nan")] * 4), (2004, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4), (3, [0.1] * 4), (3, [0.2] * 4), (2005, [0.0] * 4)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, cluster int, rest double")
    found, cent = centroids.cluster(df, k=k, rounds=6, dims=4, checkpoint_every=3)
    want, means = brute_clusters(rows, k, 6, 4)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want and cent.tolist() == means


def test_bounds_save_work_and_stay_exact():
    g = np.random.default_rng(2)
    x = (g.normal(size=(3000, 8)) * 40 + g.integers(0, 12, 3000)[:, None] * 500).astype(np.int64)
    cent = x[:24].copy()
    b, asked = centroids.Bounds(x, cent, 6), []
    for keep in (6, 6, 4, 4, 3, 3, 3, 3):
        d = centroids.scan(x, cent)
        assert (b.cluster == d.argmin(axis=1)).all()
        new = np.array([x[b.cluster == c].sum(axis=0) // max(1, (b.cluster == c).sum()) if (b.cluster == c).any() else cent[c] for c in range(24)])
        b.move(cent, new, keep)
        cent = new
        asked.append(float((b.asked == 0).mean()))
    assert (b.cluster == centroids.scan(x, cent).argmin(axis=1)).all() and asked[-1] > 0.9


def test_too_few_or_too_large_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    found, cent = centroids.cluster(df, dims=2)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0)] and cent.tolist() == [[1024, 2048]]
    assert centroids.cluster(df.where("vec_id = 2"), dims=2)[0].count() == 0
    with pytest.raises(Exception, match="is over"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>"), dims=2)


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_centroids"])
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_token_query_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    t, want, start = Tokenizer.from_file(token_files.tokenizer_path()), [], 0
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in registry.queries()["op12_token_files"](spark, sf_dir).orderBy("doc_id").collect()] == want


# --- op2: small sources; columns with any names -----------------------------------------------------------------


def mixed(spark, sizes: dict):
    rows = [(i, source, n) for i, (source, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out: dict = {}
    for r in mixing.pareto_mix(sized, mixing.source_targets(sized)).collect():
        assert 0 <= r.taken <= 3 * r.size
        total, _ = out.get(r.source, (0, 0))
        out[r.source] = (total + r.taken, r.target)
    return out


@pytest.mark.parametrize("sizes", [{"A": [1, 1, 1], "B": [1]}, {"A": [1], "B": [1], "C": [1]}, {"A": [1, 2], "B": [5], None: [1, 1]}, {"A": [3, 0], "B": [0]}, {"A": [2, 2, 2, 1], "B": [4, 1, 5], "C": [1], "D": [1, 3]}])
def test_small_sources_meet_their_targets_to_the_word(spark, sizes):
    for taken, target in mixed(spark, sizes).values():
        assert abs(taken - target) <= 0.5 + 1e-9


def test_random_small_sources(spark):
    r = random.Random(7)
    for _ in range(4):
        sizes = {f"s{k}": [r.randint(1, 5) for _ in range(r.randint(1, 6))] for k in range(r.randint(1, 5))}
        for taken, target in mixed(spark, sizes).values():
            assert abs(taken - target) <= 0.5 + 1e-9, sizes


def test_very_long_texts_do_not_overflow(spark):
    big = 1 << 33
    sized = spark.createDataFrame([(1, "A", big), (2, "A", big), (3, "B", 10)], "doc_id long, source string, size long")
    assert mixing.pareto_mix(sized, mixing.source_targets(sized)).count() == 3


CLASHING = ["_id", "_digest", "_own", "_n", "_q", "_rate", "copies", "_source", "row", "id", "own", "own_id", "from", "n", "size", "digest", "kept", "score", "_each", "_u", "_cut", "component_id", "keep_id", "extra", "Row", "mark", "_S"]


@pytest.mark.parametrize("names", [CLASHING[:-3], ["Row", "mark", "_S", "Score", "a.b", "x`y"]])
def test_stages_keep_columns_of_any_name(spark, names):
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten eleven twelve", None, ""]
    rows = [(i, t, "en", f"s{i % 2}", *[f"{n}-{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    given = {r[0]: tuple(r) for r in docs.collect()}
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    import corpus_pipeline

    stages = [exact_dedup.exact_dedup_rows(docs), ngram_join.near_dedup_rows(docs), mixing.mix_documents(docs)]
    ids = [[0, 2, 3], [0, 2, 3, 4], None]
    for out, want in zip(stages, ids, strict=True):
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and all(r == given[r[0]] for r in got) and (want is None or sorted(r[0] for r in got) == want)
    name = corpus_pipeline.unused(docs, "score")
    assert name.lower() not in {c.lower() for c in docs.columns} and quality.score(docs, model, score_col=name).drop(name).columns == docs.columns


# --- op3, op5, op9: what a chunk sends does not grow with the buckets ---------------------------------------------


@pytest.mark.parametrize("shift", [5, 9, 13, 17, 24])
def test_a_chunk_sends_as_much_for_any_number_of_buckets(spark, shift):
    r = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(r.choices(words, k=r.randint(20, 400))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sent = ngram_join.emit(docs, ngram_join.shingle_measure(5), 1 << shift)
    size = sent.select(F.sum(F.octet_length("counts") + F.octet_length("marks") + F.octet_length("low") + F.octet_length("high")).alias("n"), F.count("*").alias("rows")).first()
    assert size.n < 2.2 * sum(map(len, texts)) and size.rows <= sum(len(t.split()) for t in texts) + 1


@pytest.mark.parametrize("buckets", [3, 1000, 1 << 22])
def test_shared_shingles_are_found_for_any_number_of_buckets(spark, buckets, monkeypatch):
    r = random.Random(2)
    base = [" ".join(r.choices("abcdefghijkl", k=40)) for _ in range(12)]
    texts = [*base, *[b + " tail " + str(i) for i, b in enumerate(base[:6])], "x y", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = ngram_join.ngram_join(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(ngram_join, "bucket_count", lambda *a: buckets)
    assert ngram_join.ngram_join(docs).orderBy("doc_id").collect() == want and len({x.component_id for x in want}) == 15


# --- op4: vectors whose squares leave the range of doubles ---------------------------------------------------------


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e200, 5e-324 * 2**60])
def test_links_of_tiny_and_huge_vectors(spark, scale):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (3, [scale, scale], 0), (4, [scale * 2, scale * 2], 0), (5, [scale, -scale], 0), (6, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_dedup(spark, df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}
