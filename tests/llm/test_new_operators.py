"""Online packing, centroid clustering and conversation repair against brute force and edge cases."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import clustering, online_packing, repair

DOC = "doc_id long, text string"
CONV = "conv_id long, turn long, role string, text string"


# --- Online packing ------------------------------------------------------------------------------


def whole_ids(texts):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(online_packing.tokenizer_file())
    return [np.asarray([*e.ids, 2], "<u4") for e in bpe.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [
    None, "", " \t\n ", "one", "one", "x" * 9000, "Ab cD. e's don't 12 3,4", "<|endoftext|>a <|startoftext|> b", "Straße été ÉTÉ İstanbul ΣΑΣ J̌a",
    "日本語 テキスト。漢字", "😀 emoji 👩‍👩‍👧", "a b c\x1cd\x85e\x0bf", "ﬁ ② ⅷ ² x²y", "Z ZZ zZz", "हिन्दी पाठ", "é ä ́", "  lead and trail  ", "....!!! ?!", "q" * 50 + " " + "r" * 49,
]


def test_word_encoder_matches_the_tokenizer():
    import pyarrow as pa

    r = random.Random(4)
    letters = "abcXYZéÉßñ .,!'-_09\n\t日本ж"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)]
    got = list(online_packing.WordEncoder(online_packing.tokenizer_file()).encode(pa.array(texts, pa.string())))
    assert [g + b"\2\0\0\0" for g in got] == [x.tobytes() for x in whole_ids(texts)]


def check_packing(rows, docs, limit):
    """Every id in one piece, offsets without gaps, and no padding; returns loads and pieces a row."""
    want = defaultdict(list)
    for (key, _), ids in zip(docs, whole_ids([t for _, t in docs])):
        want[key].append(ids.tobytes())
    windows, pieces = defaultdict(list), defaultdict(list)
    for p in rows:
        windows[p["sequence_id"]].append(p)
        pieces[p["doc_id"]].append(p)
        assert len(p["ids"]) == 4 * p["length"] > 0
    loads = []
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limit
        loads.append(at)
    assert all(x == limit or not x & (x - 1) for x in loads)
    assert set(pieces) == set(want)
    for key, texts in want.items():
        if len(texts) == 1:
            mine = sorted(pieces[key], key=lambda p: p["start"])
            assert b"".join(bytes(p["ids"]) for p in mine) == texts[0]
            assert all(p["doc_tokens"] == len(texts[0]) // 4 for p in mine)
            assert [p["start"] for p in mine] == [sum(q["length"] for q in mine[:i]) for i in range(len(mine))]
        else:
            assert sum(p["length"] for p in pieces[key]) == sum(map(len, texts)) // 4
    return loads


@pytest.mark.parametrize("limit,open_,parts", [(4096, 1024, 1), (64, 4, 3), (7, 2, 2), (1, 1, 1)])
def test_online_packing(spark, limit, open_, parts):
    r = random.Random(limit)
    docs = list(enumerate(ODD)) + [(100 + i, " ".join(r.choice(["tree", "of", "unlikelihood", "a.b", "42"]) for _ in range(r.randint(0, 90)))) for i in range(150)]
    docs += [(None, "no id"), (7, "another row of seven")]
    frame = spark.createDataFrame(docs, DOC).withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(parts)
    loads = check_packing(online_packing.pack(frame, limit, open_windows=open_).collect(), docs, limit)
    short = [x for x in loads if x != limit]
    assert len(short) <= parts * limit.bit_length()


def test_sum_of_squares_choice():
    """Each piece goes where the sum of squared counts is smallest, of equals into the fullest window."""
    r = random.Random(9)
    packer, counts = online_packing.Packer(20, 10**6), defaultdict(int)

    def squares(c):
        return sum(n * n for h, n in c.items() if h < 20)

    for i in range(500):
        n = r.randint(1, 19)
        options = []
        for h in [0, *[h for h, k in counts.items() if k and h + n <= 20]]:
            new = counts.copy()
            if h:
                new[h] -= 1
            new[h + n] += h + n < 20
            options.append((squares(new), -h, new))
        best = min(options, key=lambda o: (o[0], o[1]))
        packer.add(i, b"\1\0\0\0" * n)
        counts = best[2]
        assert {h: int(k) for h, k in enumerate(packer.count) if k} == {h: k for h, k in counts.items() if k}


def test_online_packing_of_nothing(spark):
    assert online_packing.pack(spark.createDataFrame([], DOC)).count() == 0


# --- Clustering ----------------------------------------------------------------------------------


def plain_clusters(vectors, k, rounds, seed):
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in vectors:
            groups[near(v)[1]].append(v)
        for c, members in groups.items():
            centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    rows = [(i, *near(v)[::-1]) for i, v in vectors]
    own = [sum(d for _, c, d in rows if c == x) for x in range(len(centroids))]
    most = 2**63 - 1
    return sorted((i, c, min(d, most), min(own[c], most), min(sum(own), most), ",".join(map(str, centroids[c]))) for i, c, d in rows)


def clusters(spark, vectors, k, dim, rounds, kind="float"):
    frame = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1))
    return sorted(map(tuple, clustering.cluster(frame.repartition(3), k, dim, rounds, 3).collect()))


def test_clustering_against_brute_force(spark):
    r = random.Random(2)
    vectors = [(i, [r.choice([-1, 0, 1]) + r.random() * 0.1 for _ in range(5)]) for i in range(200)] + [(300 + i, [0.25] * 5) for i in range(100)]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    odd = [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0, None, 1.0, 1.0, 1.0]), (904, [float("nan")] * 5), (905, [float("inf")] + [0.0] * 4)]
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors]
    assert clusters(spark, vectors + odd, 8, 5, 10) == plain_clusters(whole, 8, 10, 3)
    assert clusters(spark, vectors[:5] + vectors[:1], 8, 5, 3) == plain_clusters(whole[:5] + whole[:1], 8, 3, 3)
    assert clusters(spark, odd, 8, 5, 10) == []
    same = [(i, [0.5] * 5) for i in range(30)]
    assert clusters(spark, same, 4, 5, 3) == plain_clusters([(i, [512] * 5) for i in range(30)], 4, 3, 3)


def test_clustering_is_exact_for_large_components(spark):
    r = random.Random(5)
    vectors = [(i, [r.choice([-1, 1]) * 10.0 ** r.choice([0, 5, 12, 30]) * r.random() for _ in range(4)]) for i in range(40)]
    vectors.append((50, [1.7e308, -1.7e308, 0.0, 1e-300]))
    whole = [(i, [int(np.floor(1024 * x)) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in vectors]
    assert clusters(spark, vectors, 6, 4, 4, "double") == plain_clusters(whole, 6, 4, 3)


# --- Conversation repair -------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        at = zlib.crc32(key.encode()) % 20
        if at == 1:
            text = ""
        if at == 2:
            text = re.sub("[.!?]", "", text)
        if at == 4:
            role = "user"
        if at:
            out += [(conv, turn, role, text)] * (2 if at == 3 else 1)
    return out


def faults(rows):
    """First fault of each row of a conversation in its order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        said = text.strip(WHITE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(initials, found):
    """(cost, audit, [(edit, role initial, row)]) by growing every audit, cheapest and ASCII-least first, without ranks."""
    import heapq

    heap = [(0, "", 0, "", ())]
    done = set()
    n = len(initials)
    while heap:
        cost, audit, i, said, steps = heapq.heappop(heap)
        state = said if len(said) < 2 else said[0].replace("s", "") + said[-1]
        key = i, "" if not said else said[-1]
        if (key, audit, cost) in done:
            continue
        done.add((key, audit, cost))
        if i == n and re.fullmatch("(s?(ua)+)?", said):
            return cost, audit, steps
        if cost > 4 * n + 12:
            continue

        def grow(edit, role, more, row):
            new = said + role
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + edit, i + (edit != "I"), new, steps + ((edit, role, row),)))

        for role in "ua":
            grow("I", role, 3, None)
        if i < n:
            extra = 3 if found[i] == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, said, steps))
            if found[i] not in ("blank", "duplicate"):
                if initials[i]:
                    grow("K", initials[i], extra, i)
                for role in "ua":
                    grow("R", role, 3 + extra, i)
    raise AssertionError


def exhaustive(initials, found):
    """The same for very short conversations, over all choices of edits, checked only when whole."""
    runs = ["", "u", "a", "ua", "au", "uu", "aa"]
    best = None
    n = len(initials)
    for gaps in itertools.product(runs, repeat=n + 1):
        for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=n):
            said, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * sum(map(len, gaps))
            for i, e in enumerate(edits):
                if e != "D" and found[i] in ("blank", "duplicate"):
                    break
                audit += e[0] + "I" * len(gaps[i + 1])
                said += ("" if e == "D" else initials[i] if e == "K" else e[1]) + gaps[i + 1]
                cost += {"D": 4, "K": 0, "R": 3}[e[0]] + (3 if e != "D" and found[i] == "truncated" else 0)
            else:
                if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def ranked(initials, found):
    kinds = [(i, {"": repair.FINE, "truncated": repair.TRUNCATED}.get(f, repair.GOES)) for i, f in zip(initials, found)]
    total, at, back = repair.run_layers(kinds, repair.NONE)
    more, _, state = repair.best_end(at)
    return total + more, "".join(repair.CODES[c] for c in repair.codes_to(back, state)) + "I" * repair.missing(state)


def test_macros_are_ordered_and_prefix_free():
    assert list(repair.CODES) == sorted(repair.CODES)
    assert not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)


def test_repair_of_all_short_conversations():
    kinds = list(itertools.product("sua ", ["", "blank", "truncated"]))
    for n in (0, 1, 2):
        for rows in itertools.product(kinds, repeat=n):
            initials, found = [k[0] for k in rows], [k[1] for k in rows]
            assert ranked(initials, found) == exhaustive(initials, found)


def test_repair_of_random_conversations():
    r = random.Random(3)
    for _ in range(250):
        n = r.randint(3, 6)
        initials = [r.choice("suuaa ") for _ in range(n)]
        found = [r.choice(["", "", "", "blank", "truncated"]) for _ in range(n)]
        assert ranked(initials, found) == search(initials, found)[:2]


def plain_repair(original):
    by = defaultdict(list)
    for row in damage(original):
        by[row[0]].append(row)
    out = []
    for conv in {r[0] for r in original}:
        rows = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found, initials = faults(rows), [r[2][:1] for r in rows]
        turns = {r[1] for r in rows if r[1] is not None}
        # Long ones come from the ranked programme, which the tests above hold against plain searches.
        if len(rows) <= 7:
            cost, audit, _ = search(initials, found)
        else:
            cost, audit = ranked([i or "?" for i in initials], found)
        said, at, state = [], 0, repair.NONE
        for e in audit:
            if e == "I":
                state = repair.NEXT[state]
                said.append(repair.ROLES[state] + ":")
                continue
            role, text = rows[at][2:]
            at += 1
            if e == "K":
                state = repair.SYSTEM if role[0] == "s" else repair.NEXT[state]
                said.append(f"{role}:{text}")
            if e == "R":
                state = repair.NEXT[state]
                said.append(f"{repair.ROLES[state]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def spark_repair(spark, rows, parts, turns=False):
    frame = spark.createDataFrame(rows, CONV).withColumn("copies", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("at", F.lit(2))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made = repair.repair(repair.marked(repair.damaged(frame)), turns)
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    if turns:
        for r in got:
            assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in r["repaired"]).encode()).hexdigest() == r["repaired_sha256"]
    return sorted((tuple(r[c] for c in r.asDict() if c != "repaired") for r in got), key=lambda r: (r[0] is not None, r[0] or 0))


def random_turns(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "open", "", "  \n", "Well... \t", None, "été.", "x" * 3000 + "."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(r.choice([1, 2, 3, 5, 6])):
            turn = r.choice([turn, turn, turn, turn + 2, None])
            rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), r.choice(texts)))
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_conversation_repair(spark, parts):
    rows = random_turns(parts, 60)
    assert spark_repair(spark, rows, parts, turns=parts == 3) == plain_repair(rows)


def test_one_conversation_over_many_partitions(spark):
    """Most rows in one conversation, and many equal rows in one turn."""
    r = random.Random(8)
    rows = [(5, t, r.choice(["user", "assistant"]), r.choice(["So it is.", f"Turn {t}.", "open"])) for t in range(400)]
    rows += [(5, 41, "user", "again.")] * 60 + [(9, None, "assistant", "Null turn.")] * 5 + [(1, 1, "user", "Hi."), (1, 2, "assistant", "Ho.")]
    assert spark_repair(spark, rows, 7, turns=True) == plain_repair(rows)


def test_repair_of_dropped_and_no_conversations(spark):
    gone = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    nothing = hashlib.sha256(b"").hexdigest()
    assert spark_repair(spark, [(gone, 0, "user", "a.")], 2) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert spark_repair(spark, [], 2) == []


# --- columns whose names the stages use themselves -----------------------------------------------


def test_stages_keep_columns_of_any_name(spark):
    """Names that stages give to columns of their own, and a map, come through with their values."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    text = spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").first()["text"]
    names = ["id", "id__", "keys", "__drop", "n_lines_", "copy", "__copy", "row_a", "a", "b", "language_pred", "__lang_pred", "toxicity", "__toxicity", "lines", "dropped"]
    rows = [(i, text if i % 2 else f"{text}\nline {i} of this text", "en", "s", i) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in names}).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, d)
        assert after.columns == docs.columns, name
        before = after
    left = before.collect()
    assert left and all(r[n] == f"{n} {r['doc_id']}" and r["m"] == {"k": r["doc_id"]} for r in left for n in names)


def test_equal_texts_share_a_shard(spark):
    """Groups of up to a whole shard's bytes are in one shard, and shards are near equal all the same."""
    from lexgrove.llm import sharding

    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcde ") for _ in range(r.randint(50, 400)))) for i in range(900)]
    rows += [(2000 + 200 * g + i, f"group {g} " + "z" * 180) for g in range(9) for i in range(12 * (g + 1))]
    docs = spark.createDataFrame(rows, DOC)
    got = sharding.shard(docs, 8).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.03 * sizes.mean()
    heavy = got.groupby("text_crc32")["size"].sum()
    assert heavy.max() > sizes.mean() / 2
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
