"""Filter audit, collocations and exact duplicates against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesia.llm import audit, exactdup, phrases
from kinesia.llm import _text as tx
from kinesia.llm._shared import ship

ODD = {"a.b": "x", "tick`": "y", "count": 1, "n": 2, "part": "z", "key": 3, "sha": "w", "owner": 4, "norm": "v", "lang2": "u"}


@pytest.fixture(scope="module")
def spark_(spark):
    ship(spark)
    return spark


def frame(spark, rows, schema, odd=True):
    df = spark.createDataFrame(rows, schema)
    for name, value in ODD.items() if odd else ():
        df = df.withColumn(name, F.lit(value))
    return df


# ---------------------------------------------------------------- exact duplicates

TEXTS = ["one two", "onetwo", " one\ttwo\n", "One two", "", None, " \n", " ", "é a", "éa", "x" * 300_000, "x" * 150_000 + " " + "x" * 150_000, "a\x0bb", "ab", "a\x1fb"]


def exact_brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for norm, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], best[3], len(members), m[3] == best[3] and m[0] == best[0], sha) for m in members]
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"key_bits": 2, "bucket_bytes": 64, "held_bytes": 200}, {"key_bits": 0}, {"bucket_bytes": 1000, "held_bytes": 1}])
def test_exact_duplicates_equal_brute_force_and_chains_settle_collisions(spark_, options):
    rng = random.Random(3)
    rows = [(i, rng.choice(TEXTS)) for i in range(90)] + [(None, "onetwo"), (None, None), (7, "one two"), (7, "o n e t w o")]
    out = exactdup.exact_duplicates(frame(spark_, rows, "doc_id long, text string").repartition(5), **options)
    assert out.columns == list(exactdup.RESULT)
    assert Counter(map(tuple, out.collect())) == exact_brute(rows)


def test_directory_splits_until_buckets_fit_or_hold_one_key(spark_):
    rows = [(i, f"text {i} " + "z" * (4000 if i == 5 else 20)) for i in range(200)]
    found = exactdup.index(frame(spark_, rows, "doc_id long, text string"), bucket_bytes=300)
    buckets = {(b.prefix, b.depth): b.bytes for b in found.buckets.collect()}
    records = found.records.collect()
    inside = Counter()
    for r in records:
        own = [(p, d) for p, d in buckets if r.key >> (exactdup.KEY_BITS - d) == p]
        assert len(own) == 1, "the directory is a partition of the keys"
        inside[own[0]] += len(r.norm)
    assert inside == buckets and len({d for _, d in buckets}) > 1
    assert all(v <= 300 or v > 4000 for v in buckets.values())


def test_chains_number_the_texts_of_a_key(spark_):
    rows = [(i, f"t{i % 6}") for i in range(30)]
    records = exactdup.index(frame(spark_, rows, "doc_id long, text string"), key_bits=0).records.collect()
    assert sorted((r.key, r.chain, r.group_size, r.keep_id) for r in records) == sorted((0, c, 5, k) for c, k in zip(range(6), [r.keep_id for r in sorted(records, key=lambda r: r.chain)]))
    assert {r.keep_id for r in records} == set(range(6))


def test_exact_duplicates_of_many_split_buckets_and_of_none(spark_, monkeypatch):
    monkeypatch.setattr(exactdup, "MAX_SPLIT", 1)
    rows = [(i, f"text {i // 2}") for i in range(120)]
    out = exactdup.exact_duplicates(frame(spark_, rows, "doc_id long, text string"), bucket_bytes=20)
    assert Counter(map(tuple, out.collect())) == exact_brute(rows)
    assert exactdup.exact_duplicates(frame(spark_, [], "doc_id long, text string")).collect() == []


# ---------------------------------------------------------------- filter audit


def audit_brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    parts = defaultdict(list)
    for doc, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": t in least and (doc is None or doc > least[t]),
        }
        parts[part or ""].append((doc, {k for k, v in fails.items() if v}))
    out = set()
    for part, docs in parts.items():
        removed_by = Counter()
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed_by[f] += len(gone)
                steps.append((order, k, f, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out |= {(part, o, k, kept, gone, redundant, only, g, t, removed_by[f]) for o, k, f, kept, gone, redundant, only, g, t in steps}
    return out


def test_audit_equals_filters_applied_in_every_order(spark_):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        words = [rng.choice(["alpha", "beta", "x1", "Gamma", "UP", "é"] + [f"w{k}" for k in range(rng.choice([2, 400]))]) for _ in range(rng.choice([0, 3, 150, 260]))]
        rows.append((i, " ".join(words) + rng.choice(["", "", " #", "|"]), rng.choice(["s1", "s2", None, ""])))
    rows += [(200 + i, rows[i % 3][1], "s1") for i in range(20)] + [(300, None, "s2"), (301, None, None), (None, rows[0][1], "s1"), (None, "only none", "s1"), (5, rows[5][1], "s2"), (5, rows[5][1], "s2")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 150, 2)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    docs = frame(spark_, rows, "doc_id long, text string, source string").drop("part").withColumn("good", F.lit(1)).withColumn("A", F.lit(7))
    out = audit.interactions(audit.joint_failures(docs.repartition(4), spark_.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert out.columns == ["part", "filter_order", "step", *audit.FIGURES]
    got = list(map(tuple, out.collect()))
    assert len(got) == 3 * 600 and set(got) == audit_brute(rows, labels)


def test_joint_counts_are_those_of_flag_products(spark_):
    rows = [(1, "# A", "s"), (2, "# A", "s"), (3, "plain " * 10, "s")]
    labels = spark_.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    joint = {r.filters: r.n for r in audit.joint_failures(frame(spark_, rows, "doc_id long, text string, source string").drop("part"), labels).collect()}
    assert len(joint) == 32 and joint[0] == 3 and joint[1] == 3
    assert joint[0b01101] == 2 and joint[0b11101] == 1 and joint[0b00010] == 1 and joint[0b00011] == 1 and joint[0b11111] == 0


def test_audit_of_an_empty_table(spark_):
    labels = spark_.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark_.createDataFrame([], "doc_id long, text string, source string")
    assert audit.interactions(audit.joint_failures(docs, labels)).collect() == []


# ---------------------------------------------------------------- collocations


def phrase_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        own = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[own] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[own][tuple(words[i : i + m])] += 1
    return f, n


def phrases_brute(rows, least, top):
    f, n = phrase_counts(rows)
    out = []
    for lang, table in f.items():
        found = {p: a for p, a in table.items() if a >= least and len(p) > 1}
        longest = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], a)
        rated = []
        for p, a in found.items():
            if 100 * longest[p] >= 80 * a and longest[p]:
                continue
            score, k, left, right = min((2000000 * a // (table[p[:k]] + table[p[k:]]), k, table[p[:k]], table[p[k:]]) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Ünï", "x-y", " z", "\x1f"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice([["New", "York", "City"], ["new", "york"], ["a", "b", "c", "d"], [rng.choice(vocabulary)]])
            words[-1] += rng.choice(["", "", "", ".", ",", "\n", "!?"])
        rows.append((rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "en", "de", None])))
    return [*rows, (None, "en"), ("", "fr"), ("...", None)]


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_collocations_equal_brute_force_in_shards_of_any_size(spark_, shard):
    rows = prose(5, 120)
    df = frame(spark_, rows, "text string, lang string").drop("n").repartition(3)
    out = phrases.collocations(df, least=8, top=25, shard_bytes=shard)
    assert out.columns == list(phrases.RESULT)
    assert sorted(map(tuple, out.collect())) == phrases_brute(rows, 8, 25)


def test_counts_equal_brute_force_when_the_filter_lets_everything_through(spark_, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_BLOOM_BITS", 64)
    rows = prose(9, 60)
    f, n = phrase_counts(rows)
    want = {(lang, " ".join(p), len(p), a) for lang, table in f.items() for p, a in table.items() if a >= 5}
    want |= {(lang, "", 0, a) for lang, a in n.items() if a}
    got = phrases.counts(spark_.createDataFrame(rows, "text string, lang string"), least=5).collect()
    assert {tuple(r) for r in got} == want


def test_automaton_links_states_and_counts():
    text = b"a b a b c a b"
    data = np.frombuffer(text, np.uint8)
    starts, ends, piece, owner = phrases._pieces(data, np.array([0, len(text)]))
    auto = phrases.Automaton(data, starts, ends, piece, owner)
    for d in range(4):
        for g, phrase in enumerate(auto.phrases(d, np.arange(len(auto.count[d]))).to_pylist()):
            words = phrase.split()
            assert auto.count[d][g] == sum(text.split()[i : i + d + 1] == [w.encode() for w in words] for i in range(7))
            if d:
                assert auto.phrases(d - 1, np.array([auto.link(d)[g]])).to_pylist() == [" ".join(words[1:])]
                assert auto.phrases(d - 1, np.array([auto.prefix(d)[g]])).to_pylist() == [" ".join(words[:-1])]


def test_words_with_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(tx, "span_hash", lambda data, starts, ends, lower=False: np.zeros(len(starts), np.uint64))
    text = b"aa bb aa cc"
    data = np.frombuffer(text, np.uint8)
    starts, ends, piece, owner = phrases._pieces(data, np.array([0, len(text)]))
    assert sorted(phrases.Automaton(data, starts, ends, piece, owner).count[0]) == [1, 1, 2]


def test_scores_whose_products_pass_64_bits(spark_, monkeypatch):
    big = 9_000_000_000_000_000
    table = [("en", "", 0, 4 * big), ("en", "x", 1, big), ("en", "y", 1, big + 3), ("en", "x y", 2, big - 1)]
    monkeypatch.setattr(phrases, "counts", lambda docs, **_: spark_.createDataFrame(table, "lang string, phrase string, depth int, n long"))
    rows = phrases.collocations(spark_.createDataFrame([("", "en")], "text string, lang string")).collect()
    assert [(r.phrase, r.score) for r in rows] == [("x y", 2_000_000 * (big - 1) // (2 * big + 3))]


def test_collocations_of_an_empty_table(spark_):
    assert phrases.collocations(spark_.createDataFrame([], "text string, lang string")).collect() == []


# ---------------------------------------------------------------- names of columns, prose without personal data

NAMES = ["a.b", "tick`s", "_mix", "_row", "row", "count", "_shard", "_bucket", "size", "x0", "c0", "Text2", "_c", "h", "r", "gone"]


def test_sharding_and_quality_take_columns_of_any_name(spark_):
    from kinesia.llm import quality, sharding

    rows = [(i, f"words of text number {i} " * 9, *range(len(NAMES))) for i in range(30)]
    df = spark_.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{n.replace('`', '``')}` int" for n in NAMES]]))
    out = sharding.external_shuffle(df, 3, bucket_bytes=500)
    assert out.columns == [*[c for c in df.columns if c not in sharding.RESULT], *sharding.RESULT]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 30 and all(r["a.b"] == 0 and r["tick`s"] == 1 and r["_row"] == 3 for r in got.values())
    kept = quality.keep_good(df, None)
    assert kept.columns == df.columns and [tuple(r)[2:] for r in kept.limit(1).collect()] in ([tuple(range(len(NAMES)))], [])


CLEAN = """
+49 30 1234567 acht Uhr|+33 1 23 45 67 89 un appel|+34 912 345 678 dos veces|+1 (848) 555-1373 one more time|Call +44 20 7946 0958 two times
Karte 4111 1111 1111 1111 eins von zwei|card 4111 1111 1111 1111 one of mine|+49 170 1234567 neun Tage|une fois +33 1 23 45 67 89 deux|+34 600 123 456 tres
Look at github.com for code|available at amazon.com today|we met at work.com|you at cafe.de|Sign up at example.org now|Find us at shop.example.com
He looked at news.org|She is working at startup.io|More information at python.org|Visit them at museum.fr|prices at market.es fell|Available only at books.com
version 1.2.3 dot four|release 10.0.2 dot one|Kapitel 1.2.3 Punkt vier|la version 4.5.6 point sept|seccion 1.2.3 punto cuatro|It is at 10.30 and at 12.99
The two of them sat at one table|Zwei plus drei sind fünf|un deux trois|uno dos tres cuatro cinco|from nine to five|at six dot|one point five million|drei Punkt fünf Prozent
Meet us @ cafe.de|Order now @ shop.com|Nummer 12 acht Tage|room 101 one floor up|12 345 678 neuf|page 9 of 10 at most|posted at blog.example.com yesterday
""".strip().replace("\n", "|").split("|")

DISGUISED = [
    ("john[@]example[.]com", "john[@]example[.]com"), ("john @ example.com", "john @ example.com"), ("john&#64;example.com", "john&#64;example.com"), ("j.doe&#x40;example.org", "j.doe&#x40;example.org"),
    ("write to anna at example.com", "anna at example.com"), ("john.doe at mail.example.com", "john.doe at mail.example.com"), ("mary7 at work dot com", "mary7 at work dot com"), ("sales ( at ) firm (dot) de", "sales ( at ) firm (dot) de"),
]


@pytest.mark.parametrize("text", CLEAN)
def test_prose_with_numbers_and_sites_adds_nothing(text):
    from kinesia.llm import pii

    for t in (text, f"Yes, {text}.", f"{text}, and so on"):
        assert pii.added_spans(t, pii.base_spans(t)) == []


@pytest.mark.parametrize(("text", "found"), DISGUISED)
def test_disguised_addresses_are_found(text, found):
    import pyarrow as pa

    from kinesia.llm import pii

    assert [text[a:b] for _, a, b in pii.added_spans(text, pii.base_spans(text))] == [found]
    assert pii.suspects(*tx.texts(pa.array([text])))[1].tolist() == [True]


def test_pipeline_passes_columns_of_any_name_through(spark_, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"wort{k}" for k in range(300)]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(6)) for _ in range(24)]
    rows = [(i, t, "de", f"src{i % 3}", len(t), *range(len(NAMES))) for i, t in enumerate([*texts, texts[0]])]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{n.replace('`', '``')}` int" for n in NAMES]])
    spark_.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark_.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark_.createDataFrame([(1, " ".join(texts[3].split()[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark_, str(tmp_path))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and [c for c in out.columns if c in NAMES] == [n for n in NAMES if n != "size"] + ["size"]
    assert 24 not in got and 3 not in got and len(got) >= 18
    assert all((r["a.b"], r["tick`s"], r["_mix"], r["count"], r["gone"]) == (0, 1, 2, 5, 15) for r in got.values())
