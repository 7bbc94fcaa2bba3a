"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexgrove.llm import chat, fingerprint, language, line_dedup, packing, sentencepieces, sharding, simhash, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "no id here at all", "en", None, 3),
    (5, "x" * 5000, None, "a", 5000), (6, "Die Straße\nund der Wald", "de", "b", 20), (7, "日本語 😀 text", "en", "b", 10), (8, "<|endoftext|> a  b", "en", "b", 10),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOC)


def random_docs(n=60, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(200)]
    out = []
    for i in range(n):
        if i % 4 == 3:
            words = out[r.randrange(len(out))][1].split(" ")
            words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        out.append((i, " ".join(words), r.choice(["en", "de"]), "s", 1))
    return out


# --- SimHash -------------------------------------------------------------------------------------


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    bits = Counter(k for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(grams))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(spark):
    rows = random_docs(80)
    got = {r["doc_id"]: r for r in simhash.components(docs_of(spark, rows)).collect()}
    prints = {i: brute_simhash(t) for i, t, *_ in rows}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


def test_simhash_edges_and_empty(spark):
    found = simhash.components(docs_of(spark, EDGE)).collect()
    assert len(found) == len(EDGE)
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.components(docs_of(spark, [])).count() == 0
    kept = simhash.near_duplicates(docs_of(spark, EDGE).selectExpr("*", "1 as fp", "2 as component_id"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i in (1, 2, 3, 4)) == [1, 4] and kept.columns[-2:] == ["fp", "component_id"]


def test_near_duplicates_with_null_and_shared_ids(spark):
    text = {k: " ".join(hashlib.sha256(f"{k}{i}".encode()).hexdigest()[:6] for i in range(40)) for k in "abcdefg"}
    shared = [(None, "a"), (10, "a"), (11, "a"), (None, "b"), (None, "b"), (None, "c"), (5, "d"), (5, "e"), (9, "e"), (6, "f"), (6, "f"), (5, "g"), (3, "g")]
    kept = simhash.near_duplicates(docs_of(spark, [(i, text[k], "en", "s", n) for n, (i, k) in enumerate(shared)] + [(6, text["f"], "en", "s", 9)])).collect()
    assert sorted((r["text"], r["doc_id"]) for r in kept if r["doc_id"] is not None) == sorted((text[k], i) for k, i in (("a", 10), ("d", 5), ("e", 5), ("f", 6), ("g", 3)))
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == sorted((text["b"], text["c"]))
    swapped = simhash.near_duplicates(docs_of(spark, [(None, None, text["a"], None, None), (None, text["a"], None, None, None)])).collect()
    assert len(swapped) == 2


def groups_of(values, edges):
    parent = {x: x for x in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        parent[find(x)] = find(y)
    out = {}
    for x in values:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


def test_links_in_dense_buckets_keep_every_group_connected(spark):
    r = np.random.default_rng(5)
    near = [np.uint64(0x0123456789ABCDEF)]
    for _ in range(300):
        bits = r.choice(64, 2, replace=False)
        near.append(near[int(r.integers(len(near)))] ^ np.uint64(1 << int(bits[0])) ^ np.uint64(1 << int(bits[1])))
    values = sorted({int(x) for x in near} | {int(x) for x in r.integers(0, 2**64, 200, dtype=np.uint64)})
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values] + [(None,)], "fp long")
    edges = [(e["src"] & (2**64 - 1), e["dst"] & (2**64 - 1)) for e in simhash.links(table).collect()]
    assert len(edges) < 70 * len(values)
    real = [(x, y) for i, x in enumerate(values) for y in values[:i] if (x ^ y).bit_count() <= 4]
    assert len(real) > 1000 and groups_of(values, edges) == groups_of(values, real)
    for small in (8, 1000):
        cells, fp = np.zeros((len(values), 1), np.uint64), np.asarray(values, np.uint64).reshape(-1, 1)
        a, b = simhash._bucket_links(cells, fp, 4, small, None)
        assert len(a) < len(values) and groups_of(values, [(values[i], values[j]) for i, j in zip(a, b)]) == groups_of(values, real)


def test_near_duplicates_find_similar_texts(spark):
    """Of documents with an earlier one at a similarity of 0.8 or more, 0.9 at least go; those below 0.5 to all others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = {i: t for i, t in docs.select("doc_id", "text").toPandas().itertuples(index=False) if t and len(t.split()) >= 8}
    grams = {i: {" ".join(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)} for i, t in rows.items()}
    seen = Counter(g for s in grams.values() for g in s)
    index, best, most = {}, {}, {}
    for i in sorted(grams):
        common = Counter(j for g in grams[i] if 1 < seen[g] <= 200 for j in index.get(g, ()))
        for j, n in common.items():
            sim = n / (len(grams[i]) + len(grams[j]) - n)
            best[i] = max(best.get(i, 0), sim)
            most[i], most[j] = max(most.get(i, 0), sim), max(most.get(j, 0), sim)
        for g in grams[i]:
            index.setdefault(g, []).append(i)
    kept = {r["doc_id"] for r in simhash.near_duplicates(docs).select("doc_id").collect()}
    near = [i for i, s in best.items() if s >= 0.8]
    alone = [i for i in grams if most.get(i, 0) < 0.5]
    assert len(near) > 300 and sum(i not in kept for i in near) >= 0.9 * len(near)
    assert sum(i in kept for i in alone) >= 0.995 * len(alone)


def test_grids_grow_with_the_input():
    plans = [simhash.grid_plan(n) for n in (0, 10**5, 10**7, 10**9)]
    assert all(a <= c and b <= d for (a, b), (c, d) in zip(plans, plans[1:])) and plans[0][0] == 8


def test_embedding_is_a_lower_bound():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 2**64, 2000, dtype=np.uint64) for _ in range(2))
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) <= np.bitwise_count(a ^ b)).all()
    assert (simhash._first_cell() >= 0).sum() == sum(1 for x in range(256) if x.bit_count() <= 4)


# --- packing -------------------------------------------------------------------------------------


def test_packing_matches_tokenizer_and_has_no_gaps(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = EDGE + [(100 + i, t * 9, *x) for i, t, *x in random_docs(40)]
    got = packing.pack_documents(docs_of(spark, rows)).toPandas()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.asarray(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at, k, p = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want[(i, p, at, k, zlib.crc32(ids[at : at + k].tobytes()))] += 1
            at, k, p = at + k, 1024, p + 1
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    counts = np.bincount(got.length, minlength=1026)[:1026]
    assert got.sequence_id.nunique() <= packing.dual_feasible_bound(counts) + 1


def test_ids_of_whole_documents_match_the_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, docs = Tokenizer.from_file(P.path("byte_bpe_50k.json")), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    encoder = packing.Encoder(*packing.tokenizer_files()[1:])
    for _, t in docs.collect():
        assert np.frombuffer(encoder.encode(t or ""), "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_certificate(spark):
    lengths = [700] * 30 + [300] * 30 + [24] * 30 + [1024] * 3
    packed = packing.pack(spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long"))
    assert tuple(packing.certificate(packed).first()) == (33, 33, 0)
    assert tuple(packing.certificate(packing.pack_documents(docs_of(spark, []))).first()) == (0, 0, 0)


def test_bounds_and_best_fit():
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths = r.integers(1, 100, 60)
        bins, offsets, loads = packing.best_fit_decreasing(lengths, 100)
        assert loads.max() <= 100 and loads.sum() == lengths.sum()
        bound = packing.dual_feasible_bound(np.bincount(lengths, minlength=102)[:102], 100)
        assert bound <= len(loads)
        again = packing.repack(lengths, bins, offsets, loads, 100)
        assert bound <= len(again[2]) <= len(loads) and again[2].sum() == lengths.sum() and again[2].max() <= 100
    assert packing.dual_feasible_bound(np.bincount([51] * 7, minlength=102)[:102], 100) == 7


def test_packing_exchanges_over_partitions(spark):
    r = random.Random(2)
    rows = [(i, 0, 0, r.randint(1, 1023), i) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), per_part=700).toPandas()
    assert len(got) == 3000 and got.groupby("sequence_id").length.sum().max() <= 1024
    bound = packing.dual_feasible_bound(np.bincount(got.length, minlength=1026)[:1026])
    assert got.sequence_id.nunique() <= 1.01 * bound
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


# --- line dedup ----------------------------------------------------------------------------------


def brute_lines(rows):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))

    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in rows}


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup(spark, batches):
    r = random.Random(4)
    lines = ["short", "A Line that Repeats", "a line that repeats ", "éééééééééé", "ééééééééé", "\tanother quite common line\r", "", "unique"]
    rows = [(i, "\n".join(r.choice(lines) + (str(r.random()) if r.random() < 0.3 else "") for _ in range(r.randint(0, 9))), "en", "s", 1) for i in range(70)]
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs_of(spark, rows), batches).collect()}
    want = brute_lines([(i, t) for i, t, *_ in rows])
    assert {i: x["text"] for i, x in got.items()} == want
    assert all(x["n_lines"] == rows[i][1].count("\n") + 1 for i, x in got.items())


def test_line_dedup_edges(spark):
    got = line_dedup.dedup_lines(docs_of(spark, EDGE).selectExpr("*", "5 as n_lines", "6 as id"))
    assert got.count() == len(EDGE) and got.where("text is null").count() == 1 and got.where("n_dropped > 0").count() == 0
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


# --- classifiers ---------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).withColumn("held", language.is_held_out()).where("held").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_language_edges(spark):
    docs = docs_of(spark, EDGE)
    got = language.identify(docs).collect()
    assert len(got) == len(EDGE) and all(r["lang_pred"] == "und" and r["lang_score"] == 0 for r in got if not r["text"] or not any(c.isalpha() for c in r["text"]))
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(docs_of(spark, [])).count() == 0
    assert language.known_language(docs).columns == docs.columns


def test_language_learns_distinct_texts(spark):
    text = "format_string('%s text %s', if(lang = 'rare', 'wenig bekannte worte', 'many different words'), {})"
    few = spark.range(60000).selectExpr("id as doc_id", "'rare' as lang").selectExpr("*", text.format("doc_id % 30") + " as text")
    many = spark.range(60000).selectExpr("id as doc_id", "'common' as lang").selectExpr("*", text.format("if(doc_id < 57000, 0, doc_id)") + " as text")
    got = {lang: raw.decode().split("\n") for lang, raw in language.learn(few.unionByName(many)).items()}
    assert sorted(got["rare"]) == sorted(f"wenig bekannte worte text {i}" for i in range(30))
    assert len(got["common"]) == len(set(got["common"])) == language.SAMPLE_DOCS


def test_language_takes_whole_texts_and_a_lone_long_one(spark):
    rows = [(i, f"{'lang' * 20} {i}", "de", "s", 1) for i in range(1, 60)] + [(i, "mot " * 50_000 + str(i), "fr", "s", 1) for i in range(100, 109)]
    got = language.learn(docs_of(spark, rows), total=2000)
    texts = {t for _, t, *_ in rows}
    assert len(got["de"]) <= 2000 + 100 and set(got["de"].decode().split("\n")) <= texts and got["fr"].decode() in texts


def test_language_against_plain_compression(spark):
    """Predictions are those of a plain loop over languages, and narrow leads are rejected."""
    import zstandard as z

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    raws = language.learn(docs)
    for r in language.identify(docs, raws).where("lang_pred <> 'und'").collect():
        sizes = {}
        for lang, raw in raws.items():
            p = z.ZstdCompressionParameters.from_level(language.LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            c = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p)
            t = r["text"].lower().encode()
            sizes[lang] = sum(len(c.compress(t[i : i + 8192])) for i in range(0, len(t), 8192))
        order = sorted(sizes.items(), key=lambda x: (x[1], list(raws).index(x[0])))
        if order[1][1] - order[0][1] > 0.02 * order[0][1]:
            assert r["lang_pred"] == order[0][0] and not r["lang_rejected"]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.is_held_out()).toPandas()
    assert (got.toxicity[got.toxic == 1] >= 0.7).mean() > 0.88 and (got.toxicity[got.toxic == 0] >= 0.7).mean() < 0.01


def test_toxicity_tables_and_lists_give_the_same_model(spark):
    """Fitting over tables equals fitting the same texts at hand; copies, null texts and other labels change nothing."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["sun", "tree", "river", "women", "men"]) for _ in range(6)) + (" idiot" if i % 3 == 0 else "") + f" x{i}", "en", "s", 1) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows] + [(1, 7), (None, 1), (900, 1), (901, 0)], "doc_id long, toxic long")
    copies = [(900, None, "en", "s", 1), (901, "", "en", "s", 1), rows[0], rows[0]]
    model = toxicity.learn(docs_of(spark, rows + copies), labels)
    train = [(t, int(i % 3 == 0)) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1] + ([("", 0)] if zlib.crc32(b"901") % 3 != 1 else [])
    brute = toxicity.fit(train)
    assert all(abs(model.score(t) - brute.score(t)) < 1e-3 for _, t, *_ in rows)
    empty = toxicity.learn(docs_of(spark, []), labels)
    assert empty.score("x") == 0.5
    got = toxicity.not_toxic(docs_of(spark, rows).withColumn("toxicity", F.lit("own")), labels)
    assert got.columns[-1] == "toxicity" and {x["toxicity"] for x in got.collect()} == {"own"}
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_counterfactual_swaps_keep_scores_close(spark):
    rows = [(f"the {g} said hello {i}", 0) for i in range(30) for g in ("women", "men")] + [(f"you idiot {g} number {i}", 1) for i in range(40) for g in ("women",)]
    model = toxicity.fit(rows, ("women", "men"))
    assert abs(model.score("the women walked home") - model.score("the men walked home")) < 0.1
    assert model.score("the women walked home") < 0.7 <= model.score("you idiot")
    assert toxicity.fit([]).score("x") == 0.5
    got = toxicity.score(docs_of(spark, EDGE), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r["toxicity"] <= 1 for r in got)


# --- fingerprints --------------------------------------------------------------------------------


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    low = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    return low / (sum(x.values()) + sum(y.values()) - low) if x or y else 1.0


def test_fingerprints(spark):
    rows = random_docs(60)
    got = {r["doc_id"]: r for r in fingerprint.compare(docs_of(spark, rows)).collect()}
    texts = {i: t for i, t, *_ in rows}
    order, off, far = sorted(texts, reverse=True), [], []
    for k, i in enumerate(order):
        t, n = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off.append(got[i]["near_edited"] - jaccard(t, edited))
        far.append(got[i]["near_next"] - jaccard(t, n))
        for near, a, b in (("near_edited", got[i]["fingerprint"], got[i]["edited_fingerprint"]), ("near_next", got[i]["fingerprint"], got[order[(k + 1) % len(order)]]["fingerprint"])):
            assert got[i][near] == sum(a[4 * c : 4 * c + 4] == b[4 * c : 4 * c + 4] for c in range(64)) / 64
    assert abs(np.mean(off)) < 0.05 and np.sqrt(np.mean(np.square(off))) < 0.1 and abs(np.mean(far)) < 0.05


def test_fingerprint_edges(spark):
    got = fingerprint.compare(docs_of(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    same = {r["fingerprint"] for r in got if r["n_chars"] == 3}
    assert len(same) == 1 and all(len(r["fingerprint"]) == 256 for r in got)
    assert next(r for r in got if r["doc_id"] == 2)["near_next"] == 1.0
    assert fingerprint.compare(docs_of(spark, [])).count() == 0
    one = fingerprint.compare(docs_of(spark, [EDGE[7]])).collect()
    assert one[0]["near_next"] == 1.0


# --- sharding, search, chat, pieces --------------------------------------------------------------


def test_sharding(spark):
    rows = EDGE + [(100 + i, t, *x) for i, t, *x in random_docs(600)] + [(1000 + i, "the same text", "en", "s", 1) for i in range(1500)] + [(5000 + i, f"copy {i % 40} of a short text", "de", "s", 1) for i in range(120)]
    docs = docs_of(spark, rows).selectExpr("*", "1 as node", "2 as size", "3 as k0")
    got = sharding.shard(docs, 8).toPandas()
    assert set(got.shard) <= set(range(8))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    have = Counter((None if a != a else int(a), int(b), int(c)) for a, b, c in zip(got["doc_id"], got["size"], got["text_crc32"]))
    assert have == want
    total = got.groupby("shard")["size"].sum()
    assert total.max() - total.min() <= 2 * got["size"].max() + 0.2 * total.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    where = got.groupby("text_crc32").shard.nunique()
    assert where[zlib.crc32(b"the same text")] > 1 and (where.drop(zlib.crc32(b"the same text")) == 1).all()
    assert sharding.shard(docs_of(spark, []), 8).count() == 0
    assert sharding.shard(docs_of(spark, EDGE[:1]).drop("lang", "source"), 8).count() == 1


def test_sharding_cuts_are_weighted_medians(spark):
    """One level against a brute-force weighted median along the widest dimension."""
    r = random.Random(5)
    rows = [(r.randrange(1000) << 22 | i, 7 << 22, 7 << 22, (i * 3) << 22, r.randint(1, 500)) for i in range(400)]
    table = spark.createDataFrame(rows, "k0 long, k1 long, k2 long, k3 long, bytes long")
    got = sharding.split(table, 2).toPandas()
    left, right = got[got.node == 0], got[got.node == 1]
    assert left.k0.max() < right.k0.min()
    assert abs(int(left.bytes.sum()) - int(right.bytes.sum())) <= 500


def test_top_k(spark):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (None, [0.0] * 5), (503, [float("inf")] * 5)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 10).collect()
    vec = {i: np.floor(1024 * np.asarray(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and i < 500}
    want = [(q, n, i, s) for q in vec if q % 20 == 0 for n, (s, i) in enumerate(sorted(((int(vec[q] @ vec[i]), i) for i in vec if i != q), key=lambda x: (-x[0], x[1]))[:10], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    few = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [0.5]), (3, [0.25])], "vec_id long, embedding array<float>"), 2, 10).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 3)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_large_repeated_and_mixed_vectors(spark):
    r = random.Random(9)
    rows = [(i, [r.choice([1e9, -1e9, 3e15, 0.5, -2.0]) for _ in range(3)]) for i in range(40)] + [(10, [1e9, 1.0, 1.0]), (10, [5.0, 5.0, 5.0])] + [(100 + i, [r.random()]) for i in range(20)]
    most = (1 << 62) - 1
    ints = [(i, [max(-most, min(most, int(np.floor(1024 * x)))) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in ints if i % 10 == 0}):
        v = min(x for i, x in ints if i == q)
        scores = sorted(((max(-most, min(most, sum(a * b for a, b in zip(v, c)))), i) for i, c in ints if i != q and len(c) == len(v)), key=lambda x: (-x[0], x[1]))
        want += [(q, n, i, s) for n, (s, i) in enumerate(scores[:5], 1)]
    for _ in range(2):
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), 10, 5).collect()
        assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == sorted(want)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\<|turn|>b", "<\\|end|>", "\\\\", "<|text|><|text|>", "", None, "line\n<|turn|>user<|text|>"]
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], nasty[(c * 3 + t) % len(nasty)]) for c in range(12) for t in range(6)]
    rows += [(50, 0, "system", "s"), (50, 1, "user", "u"), (50, 2, "assistant", "a"), (51, 0, "user", "u"), (52, 0, "assistant", "a"), (None, None, None, None)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1)))
    got = {r["conv_id"]: r for r in made.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for c in range(12):
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == [(r or "", t or "") for k, _, r, t in rows if k == c]
    assert got[50]["in_order"] and got[51]["bad_turn"] == 1 and got[52]["bad_turn"] == 0 and not got[None]["in_order"]
    assert "".join(s["text"] for s in got[50]["segments"] if s["loss"]) == "a"
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    with pytest.raises(ValueError):
        chat.Template(foreign=("<|turn|>x",)).controls()


def test_pieces_match_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    r = random.Random(6)
    chars = "abcdefghijklmnopqrstuvwxyz the in er éß日.,!?0123456789 \n\t😀"
    texts = [None, "", " ", "a", " a  b ", "▁x▁▁y", "x" * 500, "a</s>b<s>", *(" " * k + "x" for k in range(40)), *("".join(r.choice(chars) for _ in range(r.randint(1, 60))) for _ in range(400))]
    coded = sentencepieces.encode(docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]).withColumnRenamed("source", "piece_ids"))
    got = {x["doc_id"]: x for x in sentencepieces.decode(coded).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "")
        assert np.frombuffer(bytes(got[i]["piece_ids"]), "<u4").tolist() == want and got[i]["decoded"] == lib.decode(want)


def test_long_words_match_the_library():
    """Unspaced text and encoded data over several windows, in time that grows with the length."""
    import base64
    import time

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    e, r = sentencepieces.Encoder(sentencepieces.load(sentencepieces.default_model())), random.Random(2)
    encoded = base64.b64encode(r.randbytes(90_000)).decode()
    texts = [encoded, "".join(r.choice("的一是不了人我在有他这") for _ in range(3000)), "ab" * 700, "😀é" * 400, ("word" * 200 + " ") * 3 + "x", "a" * 513, "a" * 512]
    for t, got in zip(texts, e.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t)
    began = time.monotonic()
    e.encode([encoded * 3])
    assert time.monotonic() - began < 60
    p = sentencepieces.Pieces(("<unk>", "▁", "▁a", "a", "b", "ab", "aba", "ba"), (0.0, -3.0, -2.0, -2.5, -2.6, -3.1, -4.0, -3.4), (2, 1, 1, 1, 1, 1, 1, 1), False, True)
    u = sentencepieces.Encoder(p)
    for n in (3, 40, 300):
        w = "▁" + "".join(r.choice("abc") for _ in range(n))
        assert u._alone(w) == u._advance([w], np.asarray([len(w)]))[0]


def test_unigram_viterbi_is_optimal():
    texts = ["▁", "▁a", "a", "b", "ab", "aba", "ba", "▁ab"]
    scores = [-3.0, -2.0, -2.5, -2.6, -3.1, -4.0, -3.4, -3.9]
    p = sentencepieces.Pieces(("<unk>", *texts), (0.0, *scores), (2, *[1] * len(texts)), False, True)
    e, table = sentencepieces.Encoder(p), dict(zip(texts, scores))

    def best(s):
        return max([table[s] if s in table else -1e9] + [table[s[:k]] + best(s[k:]) for k in range(1, len(s)) if s[:k] in table], default=-1e9)

    r = random.Random(1)
    for _ in range(50):
        w = "▁" + "".join(r.choice("ab") for _ in range(r.randint(0, 8)))
        ids = np.frombuffer(e.words([w])[0], "<u4").tolist()
        assert "".join(p.texts[i] for i in ids) == w and abs(sum(p.scores[i] for i in ids) - best(w)) < 1e-9


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, d)
        assert after.columns == docs.columns, name
        assert after.count() >= 0.6 * before.count(), name
        before = after
    clean = {r["doc_id"]: r["text"] for r in before.collect()}
    prints = {i: brute_simhash(t) for i, t in clean.items()}
    assert all(i == c for i, c in brute_components(prints).items())
    packed = corpus_pipeline.pack(spark, before, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(clean)


def test_pipeline_stages_of_odd_tables(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    text = spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").first()["text"]
    rows = EDGE + [(None, text, "en", "a", 1), (None, text + " and more of the same kind of words", "en", "a", 1), (70, text, "en", "a", 1), (70, text, "en", "a", 1), (71, None, None, None, None)]
    for table in (docs_of(spark, []), docs_of(spark, rows).selectExpr("*", "1 as fp", "'x' as key", "2 as w0", "3 as n_lines", "4 as toxicity")):
        before = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, d)
            assert after.columns == table.columns, name
            before = after
        assert corpus_pipeline.pack(spark, before, d).count() >= before.count()
    left = before.collect()
    assert [r["doc_id"] for r in left].count(70) <= 1
    assert {tuple(r[c] for c in ("fp", "key", "w0", "n_lines", "toxicity")) for r in left} == {(1, "x", 2, 3, 4)}
