"""Token files, chat, archives, top-k, mixing, near duplicates, the pipeline."""

import base64
import hashlib
import json
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from noticelab.llm import _shared, chat, components, decontaminate, mixing, neardup, token_ids, topk, toxicity, warc

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")


# --- token files


@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_values_round_trip(values):
    values = np.array(values, np.uint32)
    assert (token_ids.decode_values(*token_ids.encode_values(values), len(values)) == values).all()


def test_lengths_of_values():
    control, data = token_ids.encode_values(np.array([0, 255, 256, 65536, 1 << 24]))
    assert len(data) == 1 + 1 + 2 + 3 + 4 and len(control) == 2 and control[0] == 0b10010000


def test_a_damaged_file_is_refused():
    blob = token_ids.pack(np.array([7]), np.array([0]), np.array([2]), np.array([0, 1]), np.array([5, 9]))
    assert token_ids.unpack(blob)[3].tolist() == [5, 9]
    with pytest.raises(ValueError):
        token_ids.unpack(blob[:-6] + bytes([blob[-6] ^ 1]) + blob[-5:])


def test_token_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    odd = ["İstanbul ΣΑΣ Σ", "été É", "a<|endoftext|>b", "x\x01y \x01", "it's, don't.   ﬁ", "word " * 60_000, "«ñandú», ¡SÍ! 12 3.4", " \n\n ", "A,B. c,"]
    texts = {i: t for i, t in enumerate(odd)} | {100: None, 101: "", 102: "same"}
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(102, "same"), (None, "no id")], "doc_id long, text string")
    got = token_ids.read(token_ids.write(rows)).orderBy("start").collect()
    tok, start = Tokenizer.from_file(token_ids.tokenizer_path()), 0
    for r, (i, t) in zip(got, [(None, "no id")] + sorted([*texts.items(), (102, "same")], key=lambda x: x[0]), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_ids.read(token_ids.write(rows.limit(0))).count() == 0


# --- chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to[ol]\n"]), st.text("<>[]/\\INSTs-n\n é", max_size=20)), max_size=6))
def test_formatting_round_trip(turns):
    text, loss = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_layouts_agree():
    want = [("user", "q"), ("assistant", "a")]
    maps = chat.registry()
    for record in ({"messages": [{"role": r, "content": t} for r, t in want]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"}):
        assert chat.canonical(json.loads(json.dumps(record)), maps) == want
    assert chat.canonical({"messages": []}, maps) == []
    with pytest.raises(chat.UnknownLayout):
        chat.canonical({"prompt": {"deep": 1}}, maps)


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "[/INST]"), (2, 0, "tool", ""), (None, 0, None, "x"), (5, 1, "assistant", "b" * 1_500_000)] + [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(700)] + [(4, 0, "user", "twice")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(_shared.written(chat.format_records(chat.records(df)), "chat")).collect()}
    for key in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in sorted((r for r in rows if r[0] == key), key=lambda r: r[1])]
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[key]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.read_back(chat.format_records(chat.records(df.limit(0)))).count() == 0


# --- archives


def test_archives(spark):
    rows = [(3, "u", "<p>é</p>"), (1, "u\r\nX: y", "<p>é</p>"), (2, None, None), (9, "v", ""), (5, "w", "z" * 3_000_000), (1, "u", "<p>é</p>"), (None, "n", "<p>é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["record_type"]), r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read(warc.write(df)).collect())
    b32 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    p = "<p>é</p>"
    assert got == [((0, "response"), 9, b32(p), None), ((1, "response"), 9, b32(p), None), ((1, "revisit"), 9, b32(p), 1), ((2, "response"), 0, b32(""), None), ((3, "revisit"), 9, b32(p), 1), ((5, "response"), 3_000_000, b32("z" * 3_000_000), None), ((9, "revisit"), 0, b32(""), 2)]
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_small_payloads_may_be_spared(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.read(warc.write(df, minimum=2)).collect()} == {"response"}


def test_damaged_archives_are_refused():
    data = [warc.record(i, "u", bytes([i]) * 500, None) for i in range(5)]
    writer = warc.Writer(data)
    for x in data:
        writer.add(x)
    blob = b"".join(writer.parts)
    assert [warc.page(*r)[0] for r in warc.records(blob)] == list(range(5))
    for bad in (blob[:-1], blob[8:], blob + b"junk"):
        with pytest.raises((warc.Damaged, Exception)):
            list(warc.records(bad))
    with pytest.raises(warc.Damaged):
        warc.parse(data[0].replace(b"Content-Length: ", b"Content-Length: 1"))
    with pytest.raises(warc.Damaged):
        warc.page(*warc.parse(data[1].replace(b"\x01\x01", b"\x02\x01")))


# --- top-k


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(400 + i, [0.5] * 6) for i in range(40)] + [(7, [0.5] * 6), (900, None), (901, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [1.0] * 5), (None, [1.0] * 6), (904, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in topk.top_k(df.where("vec_id % 50 = 0"), df, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    good = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all()]
    for q, x in ((i, x) for i, x in good if i % 50 == 0):
        want = sorted(((int(x @ y), i) for i, y in good if i != q), key=lambda p: (-p[0], p[1]))[:5]
        assert [got[q][k + 1] for k in range(5)] == want


def test_top_k_with_large_numbers_and_few_rows(spark):
    df = spark.createDataFrame([(0, [3e4, 1.0]), (1, [3e4, 2.0]), (2, [-3e4, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df.where("vec_id = 0"), df).orderBy("rank").collect()]
    assert got == [(1, 7680000**2 + 256 * 512), (2, -(7680000**2))]
    assert topk.top_k(df.limit(0), df).count() == 0


# --- mixing


def brute_mix(rows, share, epochs):
    def fill(items, budget):
        """items: name -> (weight, capacity)"""
        out, open_ = {}, dict(items)
        budget = min(budget, sum(c for _, c in items.values()))
        while open_:
            w = sum(x for x, _ in open_.values())
            met = {k for k, (x, c) in open_.items() if c * w <= budget * x}
            if not met:
                return out | {k: budget * x // w for k, (x, _) in open_.items()}
            for k in met:
                out[k] = open_.pop(k)[1]
            budget -= sum(out[k] for k in met)
        return out

    size = lambda t: len((t or "").split())
    weigh = lambda level, n: mixing.WEIGHTS[level].get(n, mixing.DEFAULT_WEIGHT)
    dom = lambda s: f"d{int(s[3:]) % 3}" if s else "other"
    leaves = Counter()
    for _, t, lang, s in rows:
        leaves[dom(s), lang or "", s or ""] += size(t)
    cap = lambda pre: sum(n * epochs for k, n in leaves.items() if k[: len(pre)] == pre)
    plan = {(): sum(leaves.values()) * share // 100}
    for depth, level in enumerate(("domain", "lang", "source")):
        for pre in [p for p in plan if len(p) == depth]:
            kids = {k[: depth + 1] for k in leaves if k[:depth] == pre}
            plan |= fill({k: (weigh(level, k[-1]), cap(k)) for k in kids}, plan[pre])
    out = Counter()
    for leaf, tokens in leaves.items():
        if tokens:
            whole, rest = divmod(plan[leaf], tokens)
            mine = sorted((hashlib.md5(f"{mixing.SEED}:{whole + 1}:{i}".encode()).hexdigest(), i, size(t)) for i, t, lang, s in rows if (dom(s), lang or "", s or "") == leaf)
            total, end = 0, True
            for key in sorted({m[0] for m in mine}):
                group = [m for m in mine if m[0] == key]
                total += sum(m[2] for m in group)
                for _, i, _ in group:
                    if whole + (total <= rest):
                        out[i] += whole + (total <= rest)
    return out


def test_mixing_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src5", None])) for i in range(300)] + [(7, "w w w", "en", "src0"), (400, None, "fr", "src9")]
    for share, epochs in ((80, 2), (95, 1), (30, 3)):
        got = Counter()
        for r in mixing.mix(docs(spark, rows), share, epochs).collect():
            got[r["doc_id"]] += r["copies"]
        assert got == brute_mix(rows, share, epochs)
    assert mixing.mix(docs(spark, [])).count() == 0


# --- near duplicates


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().replace(b"\n", b" ").split() if t else []
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_classes_by_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n := n + 1, " ".join(copy).upper() if n % 9 == 0 else " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "one  TWO"), (1005, "w1 " * 100_000), (1006, "w1 " * 90_000)]
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(df).collect()}
    assert got == brute_classes(rows)


def test_classes_of_odd_tables(spark):
    assert neardup.classes(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f", None, None), (5, "a b c d e f", None, None), (5, "a b c d e f", None, None), (8, "a b c d e f", None, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in neardup.classes(docs(spark, rows)).collect())
    assert got == [(0, None), (5, 5), (5, 5), (8, 5)]
    kept = neardup.stage(spark, docs(spark, rows), SF).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 5]


def test_stage_with_a_repeated_id(spark):
    first, other = "a b c d e f g", "p q r s t u v"
    rows = [(None, "n o p q r s", None, None), (None, "s t u v w x", None, None), (None, None, None, None), (3, first, None, None), (3, first, None, None), (7, first, None, None), (7, other, None, None), (9, other, None, None)]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.stage(spark, docs(spark, rows), SF).collect())
    assert got == [(0, ""), (0, "n o p q r s"), (0, "s t u v w x"), (3, first), (7, other)]


def test_a_star_without_links_between_its_copies(spark):
    """2,000 copies that reach 0.75 with one text but not with each other."""
    hub = [f"h{i}" for i in range(404)]
    rng, places = random.Random(9), [*range(4, 400, 5)]
    rows = [(5000, " ".join(hub))]
    for n in range(2000):
        copy = list(hub)
        for at in rng.sample(places, 11):
            copy[at] = f"x{n}"
        rows.append((n + 1 if n % 2 else n + 6000, " ".join(copy)))
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = [r["doc_id"] for r in neardup.classes(df).collect() if r["component_id"] != 2]
    assert not got


@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=12, unique=True), min_size=2, max_size=10))
def test_exact_links(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    parent = list(range(len(sets)))

    def close(links):
        group = {i: {i} for i in parent}
        for a, b in links:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
        return {frozenset(g) for g in group.values()}

    want = [(i, j) for i in parent for j in parent if i < j and 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))]
    assert close(neardup.exact_links(arrays)) == close(want)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(500, 400), (400, 450), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {400: 400, 450: 400, 500: 400}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- the pipeline, stage by stage against plain versions


def test_pipeline(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(rows, labels)
    kept = [r for r in rows.collect() if toxicity.score([r["text"]], model)[0] < 0.7]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if classes[r["doc_id"]][1] == r["doc_id"]]
    idx = decontaminate.index([(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    plain = lambda t: " ".join(t.lower().split())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in decontaminate.matches([r["text"] for r in kept], idx)}
    assert all(k in leaks for k, r in enumerate(kept) if any(x in plain(r["text"] or "") for x in items))
    kept = [r for k, r in enumerate(kept) if k not in leaks]
    copies = brute_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in kept], mixing.STAGE_SHARE_PERCENT, mixing.STAGE_MAX_EPOCHS)
    kept = sorted((r for r in kept if copies[r["doc_id"]]), key=lambda r: r["doc_id"])
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(token_ids.tokenizer_path()), 0, []
    for r in kept:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("name", ["op8_topk", "op9_mixing"])
def test_sql(spark, name):
    from pathlib import Path

    from noticelab.llm import queries

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(tuple(map(str, r)) for r in got.select(*names).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
