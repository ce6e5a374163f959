import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import bpe, licenses, packing, quality, quotes, secrets, sharding, toxicity, vec, winnowing

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# ------------------------------------------------------------------ quality


def plain_counts(t):
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    tri = list(zip(w, w[1:], w[2:]))
    n = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts_and_rules(nasty, labels):
    got = quality.judge(nasty, labels).collect()
    want = Counter((i, *plain_counts(t)) for i, t in texts(nasty))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_ratio_is_that_of_plain_counts(nasty, labels):
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    split = lambda t: re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+|[^0-9A-Za-z_\x80-\U0010ffff\x20\x09-\x0d]+", t)
    raw, target = Counter(), Counter()
    grams = {}
    for i, t in texts(nasty):
        x = split(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        g = [(a,) for a in x] + list(zip(x, x[1:]))
        grams.setdefault((i, t), g)
        raw.update(g)
        if i in good:
            target.update(g)
    w = quality.quality_weights(nasty, labels)
    t = next(t for i, t in texts(nasty) if len(t.split()) > 100)
    buf = np.frombuffer(t.encode(), np.uint8)
    got = quality.mean_log_ratio(buf, np.array([0, len(buf)]), w)[0]
    floor = quality.SMOOTHING / quality.BUCKETS
    R, T = sum(raw.values()), sum(target.values())
    g = next(v for (i, x), v in grams.items() if x == t)
    want = np.mean([np.log((target[x] / T + floor) / (raw[x] / R + floor)) for x in g])
    assert abs(got - want) < 0.05  # but for n-grams that share a bucket


def test_quality_without_labels_or_rows(nasty, nothing, no_labels):
    got = quality.judge(nasty, no_labels).collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in got)
    assert quality.judge(nothing, no_labels).count() == 0
    assert quality.keep_good(nasty, no_labels).columns == nasty.columns


def test_quality_separates_labelled_documents_it_has_not_seen(spark):
    d = "/root/testdata/sf0.1"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    r = quality.judge(docs, lab.where(~apart)).join(lab.where(apart), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {x.quality: x.k for x in r}
    assert share[1] > 0.99 and share[0] < 0.05


def test_filters_of_empty_tables_and_repeated_rows(spark, nasty, nothing, labels, no_labels):
    for keep in (quality.keep_good, toxicity.keep_clean):
        assert keep(nothing, labels).count() == 0 and keep(nothing, no_labels).columns == nothing.columns
        got = keep(nasty.unionByName(nasty), labels)
        assert got.columns == nasty.columns
        assert all(n % 2 == 0 for n in Counter(map(str, got.collect())).values())


# -------------------------------------------------------------- winnowing


def plain_fingerprint(t, k=winnowing.K, w=winnowing.WINDOW):
    units = []
    for x in re.findall(WORD, re.sub("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff])", r" \1 ", t)):
        units += list(x) if len(x) > winnowing.LONG_WORD else [x]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) % winnowing.PRIME for x in units]
    if not h:
        return []

    def roll(xs, k):
        value = 0
        for x in xs[:k]:
            value = (value * winnowing.BASE + x) % winnowing.PRIME
        yield value
        for old, new in zip(xs, xs[k:], strict=False):
            value = ((value - old * pow(winnowing.BASE, k - 1, winnowing.PRIME)) * winnowing.BASE + new) % winnowing.PRIME
            yield value

    g = list(roll(h, k))
    out = []
    for i in range(max(1, len(g) - w + 1)):
        part = g[i : i + w]
        at = max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1] != (part[at], i + at):
            out.append((part[at], i + at))
    return out


def test_winnowing_against_the_plain_way(nasty):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.doc_id) for r in nasty.collect())
    order = [(i, key[2]) for key, i in rows]
    want = Counter()
    write = lambda f: ",".join(f"{a:X}@{b}" for a, b in f)

    def like(a, b):
        x, y = {h for h, _ in a}, {h for h, _ in b}
        return round(len(x & y) / len(x | y), 9) if x | y else 1.0

    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), write(a), write(b), like(a, b), like(a, c))] += 1
    got = winnowing.digest(winnowing.fingerprints(nasty)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_winnowing_guarantee_and_empty(spark, nothing):
    shared = " ".join(f"s{i}" for i in range(winnowing.K + winnowing.WINDOW - 1))
    a, b = f"one two three {shared} four", f"five {shared} six seven eight nine"
    assert {h for h, _ in plain_fingerprint(a)} & {h for h, _ in plain_fingerprint(b)}
    assert winnowing.fingerprints(nothing).count() == 0
    one = winnowing.fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert one.edited == "a b a b"[: len("a b c d") - 3] + "a b" and one.near_next == 1.0


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6, 7, 8])
def test_winnowing_grams_of_any_length(spark, k):
    text = " ".join(f"w{i % 7}" for i in range(20))
    row = spark.createDataFrame([(text,), ("a b",), ("",)], "t string").select(winnowing.written(winnowing.fingerprint(F.col("t"), k, 3)).alias("f")).collect()
    for r, t in zip(row, (text, "a b", ""), strict=True):
        assert r.f == ",".join(f"{a:X}@{b}" for a, b in plain_fingerprint(t, k, 3))


def test_winnowing_of_text_without_blanks(spark):
    han = "".join(chr(0x4E00 + (i * 37) % 900) for i in range(300))
    code = "".join(chr(97 + (i * i + i // 3) % 26) for i in range(400))
    rows = [(1, han), (2, han[:150] + "\u4e00" + han[150:]), (3, code), (4, code[:200] + "x" + code[200:])]
    got = {r.doc_id: r for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.8 and got[3].near_next > 0.8 and got[2].near_next < 0.2


# --------------------------------------------------------------- sharding


def test_sharding_laws(nasty, nothing):
    got = sharding.digest(sharding.sharded(nasty, 16, 4)).collect()
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts(nasty))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.digest(sharding.sharded(nasty.repartition(5), 16, 4)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert sharding.sharded(nothing, 16).count() == 0


def test_sharding_of_repeated_rows_and_clashing_names(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, 7, id) as doc_id", "if(id < 2000, 'same', concat('t', id)) as text", "id as shard", "-id as slot")
    got = sharding.sharded(rows, 16, 4)
    assert got.columns == ["doc_id", "text", "input_shard", "input_slot", "shard", "grown_shard", "slot"]
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
        assert r.input_slot == -r.input_shard
    assert sum(map(len, slots.values())) == 3000 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_spreads_exactly_what_is_repeated_beyond_the_limit(spark):
    keys = F.expr("case when id < 5000 then 1 when id < 6024 then 2 when id < 7049 then 3 else id end").alias("_key")
    got = sharding._salted(spark.range(40_000).select(keys, "id"), 256)
    groups = {(r._key, r._salt): r.n for r in got.groupBy("_key", "_salt").agg(F.count("*").alias("n")).collect()}
    assert sum(groups.values()) == 40_000 and len({k for k, _ in groups}) == 40_000 - 7049 + 3
    assert groups[2, 0] == 1024 and {k for k, s in groups if s} == {1, 3}
    assert sum(k == 1 for k, _ in groups) == 20 and sum(k == 3 for k, _ in groups) == 5 and max(n for (k, _), n in groups.items() if k in (1, 3)) < 2 * 256


def test_sharding_of_one_record_a_hundred_thousand_times(spark):
    placed = sharding.sharded(spark.range(100_000).selectExpr("7L as doc_id", "'same' as text", "id"), 16)
    assert placed.select("shard").distinct().count() == 1
    slots = placed.agg(F.min("slot"), F.max("slot"), F.countDistinct("slot"), F.countDistinct("id")).first()
    assert tuple(slots) == (0, 99_999, 100_000, 100_000)


def test_sharding_slots_are_those_of_a_plain_shuffle(spark):
    rows = [(i, f"text {i}") for i in range(40)] + [(None, None)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 2, 8).collect()
    draws = spark.createDataFrame([(s, b, i) for s in range(2) for b in range(6) for i in range(1, 41)], "s int, b int, i int")
    draw = {(r.s, r.b, r.i): r.j for r in draws.select("s", "b", "i", F.pmod(F.xxhash64(F.lit(sharding.SEED), "s", "b", "i"), (F.col("i") + 1).cast("long")).alias("j")).collect()}
    key = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", F.xxhash64(F.xxhash64(F.lit(sharding.SEED + 1), "doc_id", F.coalesce("text", F.lit(""))), F.lit(0).cast("long")).alias("h"), F.coalesce("text", F.lit("")).alias("text")
    )
    of = {r.doc_id: (r.h, r.text) for r in key.collect()}
    for shard in range(2):
        mine = [r for r in got if r.shard == shard]
        count = max(1, -(-len(mine) // 8))
        at, want = 0, {}
        for b in range(count):
            members = sorted((r.doc_id for r in mine if of[r.doc_id][0] % count == b), key=lambda d: (d is not None, d or 0))
            places = list(range(len(members)))
            for i in range(len(members) - 1, 0, -1):
                j = draw[shard, b, i]
                places[i], places[j] = places[j], places[i]
            want |= {d: at + p for d, p in zip(members, places, strict=True)}
            at += len(members)
        assert {r.doc_id: r.slot for r in mine} == want


def test_written_shards_hold_their_slots_in_order(spark, nasty, tmp_path):
    sharding.write_shards(nasty, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select("*", F.input_file_name().alias("file"))
    assert back.count() == nasty.count() and "input_shard" in back.columns
    by_file = defaultdict(list)
    for r in back.collect():
        by_file[r.shard, r.file].append(r.slot)
    for shard in {s for s, _ in by_file}:
        slots = [x for (s, _), x in sorted(by_file.items()) if s == shard]
        assert [y for x in slots for y in x] == list(range(sum(map(len, slots))))


def test_fisher_yates_is_a_permutation_and_even(spark):
    rows = spark.range(3000).select("id", sharding.fisher_yates(F.lit(4), F.col("id")).alias("p")).collect()
    seen = Counter(tuple(r.p) for r in rows)
    assert all(sorted(p) == [0, 1, 2, 3] for p in seen) and len(seen) == 24
    assert max(seen.values()) < 3000 / 24 * 1.5
    assert spark.range(1).select(sharding.fisher_yates(F.lit(1), F.col("id")).alias("p")).first().p == [0]


# -------------------------------------------------------------------- BPE


def test_bpe_is_the_library(nasty, nothing, library):
    got = {(r.doc_id, r.n_tokens, r.ids, r.decoded) for r in bpe.encode_decode(nasty, PATH).collect()}
    want = set()
    for i, t in texts(nasty):
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    assert got == want
    assert bpe.encode_decode(nothing, PATH).count() == 0


def test_bpe_on_odd_text_and_after_a_reset(library, monkeypatch):
    rng = np.random.default_rng(2)
    pool = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x300, 0x330), *range(0x390, 0x3D0), 0x2028, 0x3000, 0x1F600, 0x4E00, 0xAC00, 0x130, 0x17F, 0x212A]]
    odd = ["".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(400)] + ["".join(rng.choice(list("ab'sSreveldtm !1é\n"), 25)) for _ in range(400)]
    monkeypatch.setattr(bpe, "MOST_KNOWN", 50)
    monkeypatch.setattr(bpe, "PIECE", 20)
    coder = bpe.ForcedBoundaryBPE(PATH)
    for part in (odd[:300], odd[300:]):
        out = coder.encode(part)
        for n, t in enumerate(part):
            assert out.ids[out.first[n] : out.first[n + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_of_equal_polynomials_are_told_apart(spark, library):
    for n in (1024, 2048, 4096):
        a = "".join("ae"[i.bit_count() % 2] for i in range(n))
        b = a.translate(str.maketrans("ae", "ea"))
        coder = bpe.ForcedBoundaryBPE(PATH)
        out = coder.encode([a, b])
        for k, t in enumerate((a, b)):
            assert out.ids[out.first[k] : out.first[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
        text = f"{a}\n{b}\n{a} {b}"
        data = np.frombuffer(text.encode(), np.uint8)
        counts = quality.base_counts(data, np.array([0, len(data)]))
        assert counts["n_dup_lines"][0] == 0 == plain_counts(text)[3]


def test_bpe_encodes_a_fragment_once(monkeypatch):
    """Also where a corpus has more of them than a table's first slots; their numbers stay when the table grows."""
    rng = np.random.default_rng(12)
    texts_in = [" ".join(rows) for rows in np.array(["".join(r) for r in rng.choice(list("bcdfghjklmnpqrstvwxz"), (240_000, 9))]).reshape(100, -1)]
    coder = bpe.ForcedBoundaryBPE(PATH)
    plain, seen = coder._encode_fragments, Counter()

    def counted(data, start, end, last):
        seen.update((bytes(data[a:b]), bool(c)) for a, b, c in zip(start.tolist(), end.tolist(), last.tolist(), strict=True))
        return plain(data, start, end, last)

    monkeypatch.setattr(coder, "_encode_fragments", counted)
    first, again = ([coder.encode(texts_in[k : k + 10]).ids.tolist() for k in range(0, 100, 10)] for _ in range(2))
    assert len(seen) > 200_000 and set(seen.values()) == {1} and first == again


def test_hashes_of_spans_tell_all_bytes_and_lengths():
    data = np.frombuffer(b"\0" * 40 + bytes(range(256)) * 4, np.uint8)
    spans = [(0, k) for k in range(1, 40)] + [(40 + a, 40 + a + k) for a in range(30) for k in range(1, 40)] + [(40, 40 + k) for k in (510, 511, 512, 513, 900)]
    h = bpe._span_hashes(data, *np.array(spans).T)
    assert len(set(h.tolist())) == len({bytes(data[a:b]) for a, b in spans})
    moved = bpe._span_hashes(np.concatenate([np.full(3, 7, np.uint8), data, np.full(5, 9, np.uint8)]), *(np.array(spans).T + 3))
    assert (moved == h).all()


def test_forced_cuts_are_between_bytes_no_token_has():
    coder = bpe.ForcedBoundaryBPE(PATH)
    assert coder.inside[ord("t"), ord("h")] and not coder.inside[ord(" "), ord("a")]


# ---------------------------------------------------------------- secrets


def plain_secrets(t):
    out = []
    for k, (p, f) in enumerate(
        ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), (r"AKIA[A-Z0-9]+", 0), (r"[0-9a-f]+", 0))
    ):
        for m in re.finditer(p, t, f):
            if len(m[2]) >= 6 if k == 0 else m.end() - m.start() >= (20 if k == 1 else 24):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_base_spans(nasty, nothing):
    got = secrets.digest(secrets.find_secrets(nasty)).collect()
    want = Counter((i, hashlib.sha256(plain_secrets(t).encode()).hexdigest()) for i, t in texts(nasty))
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in secrets.KINDS[:3])
    assert secrets.digest(secrets.find_secrets(nothing)).count() == 0


@pytest.fixture(scope="module")
def network(spark):
    return secrets.network_for(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_secrets_network_keeps_recall_on_held_out_findings(spark, network):
    assert network.recall >= 0.95 and network.precision >= 0.9  # on table text that was not learnt from
    codes, label = secrets.made_findings(2000, 321)
    p = secrets.probability(network, codes)
    assert (p[label > 0] >= network.threshold).mean() > 0.95
    assert (p[label == 0] >= network.threshold).mean() < 0.05
    other = secrets.table_findings(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 1000"))
    p = secrets.probability(network, other[0])
    assert (p[other[1] > 0] >= network.threshold).mean() >= 0.95
    assert (p[other[1] == 0] >= network.threshold).mean() < 0.02


def test_secrets_shard_learns_without_making_findings_anew(network, monkeypatch):
    codes, label = secrets.made_findings(64, 9)
    shard = secrets.pa.table({"label": label.astype(int), "at": range(64), "codes": [c.astype(np.uint8).tobytes() for c in codes], "shard": [0] * 64})
    monkeypatch.setattr(secrets, "made_findings", lambda *_: pytest.fail("made in a shard"))
    out = secrets._learn(network, 1.0, 7, (codes.astype(np.uint8), label))(shard)
    assert out.num_rows == len(secrets._flat(network))
    plain = []  # the convolution by loops
    for c in codes[:5]:
        x = network.embed[c]
        hidden = np.array([sum(x[t + k] @ network.conv[k] for k in range(5)) for t in range(len(c) - 4)]) + network.conv_bias
        cuts = [0, secrets.SIDE, secrets.SIDE + secrets.BODY - 4, len(hidden)]
        plain.append(np.concatenate([np.maximum(hidden[a:b].max(0), 0) for a, b in zip(cuts, cuts[1:])]) @ network.out + network.bias)
    assert np.allclose(secrets._logit(network, codes[:5]), plain)


def test_secrets_model_finds_what_patterns_miss(spark, network):
    text = "deploy with Bearer ghp_aB3dE5gH7jK9mN1pQ3sT5vW7yZ2cF4hJ6kL8 please, see https://www.example.com/some/page/12"
    r = secrets.digest(secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), network)).first()
    assert r.spans.startswith("model:19:") and r.spans.count("model") == 1


def test_long_candidates_are_read_whole(network):
    start, end = np.array([0, 5, 10]), np.array([48, 205, 59])
    which, a, b = secrets._slide(start, end)
    for k in range(3):
        mine = which == k
        assert a[mine][0] == start[k] and b[mine][-1] == end[k] and (b[mine] - a[mine] <= secrets.BODY).all()
        assert (a[mine][1:] <= b[mine][:-1]).all()
    front = "/".join(["some", "harmless", "folder", "names", "that", "go", "on"] * 2)
    text = f"see {front}/ghp_aB3dE5gH7jK9mN1pQ3sT5vW7yZ2cF4hJ6kL8 there".encode()
    assert len(front) > secrets.BODY
    out = secrets._scan_chunk(network, secrets.pa.array([1]), np.frombuffer(text, np.uint8), np.array([0, len(text)])).column(1).to_pylist()[0]
    assert [(s["kind"], s["start"]) for s in out] == [("model", 4)]


def test_a_run_beside_a_pattern_is_a_candidate(spark, network):
    token = "ghp_0123456789abcdef0123456789abQZ9xTk4LmN8pR"
    docs = spark.createDataFrame([(1, f"key {token} end", 1), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    spans = secrets.find_secrets(docs, network).where("doc_id = 1").first().spans
    assert {s.kind for s in spans} == {"hex", "model"} and {(s.start, s.end) for s in spans if s.kind == "model"} == {(4, 4 + len(token))}
    out = {r.doc_id: r.text for r in secrets.redact_secrets(docs, network).collect()}
    assert out == {1: "key [SECRET] end", 2: None, 3: ""}
    assert secrets.redact_secrets(docs.limit(0), network).count() == 0
    wholly = np.frombuffer(b"token=abcdef0123456789", np.uint8)
    assert len(secrets._places(wholly, np.array([0, len(wholly)])).free) == 0


def test_redaction(nasty, network):
    out = {r.doc_id: r for r in secrets.redact_secrets(nasty, network).collect()}
    hit = next(r for r in out.values() if r.text and "[SECRET]" in r.text)
    assert "24be6443" not in hit.text and "hunter22" not in hit.text and hit.n_chars == len(hit.text)
    assert secrets.redact("abcdef", [(1, 3), (2, 4)]) == "a[SECRET]ef"


# ---------------------------------------------------------------- packing


def test_packing_round_trip(nasty, nothing, library):
    pieces = packing.pack(nasty, PATH, window=64).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = defaultdict(list)
    for i, t in texts(nasty):
        want[i].append([*library.encode(t, add_special_tokens=False).ids, 1])
    assert by_doc.keys() == want.keys()
    for i, plain in want.items():
        if len(plain) == 1:
            parts, at = sorted(by_doc[i], key=lambda p: p.start), 0
            for p in parts:
                assert p.start == at and p.doc_tokens == len(plain[0])
                assert np.frombuffer(p.ids, "<u4").tolist() == plain[0][at : at + p.length]
                at += p.length
            assert at == len(plain[0])
        else:  # repeated rows are told apart by the windows they are in, so every id is counted
            got = Counter((p.start + k, x) for p in by_doc[i] for k, x in enumerate(np.frombuffer(p.ids, "<u4").tolist()))
            assert got == Counter((k, x) for ids in plain for k, x in enumerate(ids))
    assert packing.pack(nothing, PATH).count() == 0


def lexicon(rng, n):
    return ["".join(rng.choice(list("abdeghiklmnoprstuw"), 6)) for _ in range(n)]


def test_packing_neighbours_are_those_of_brute_force(spark):
    rng = np.random.default_rng(7)
    words = lexicon(rng, 600)
    docs = [(i, " ".join(words[k] for k in rng.zipf(1.2, packing.QUERY) % 600)) for i in range(300)]  # so short that all words are asked for
    encoded = packing.encode(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH)
    n, tokens = 300, encoded.agg({"doc_tokens": "sum"}).first()[0]
    ends = packing.word_ends(PATH)
    got = defaultdict(dict)
    for seed, rid, score in packing.neighbours(encoded, ends, n, tokens, want=10).collect():
        got[seed][rid] = score
    bags, sizes = {}, {}
    for r in encoded.where("rid is not null").collect():
        ids = packing._unpack(r.ids, r.doc_tokens, np.uint16)[:-1].tolist()
        bag, word = Counter(), []
        for x in ids:
            word.append(x)
            if ends[x]:
                bag[tuple(word)] += 1
                word = []
        bags[r.rid], sizes[r.rid] = bag, len(ids)
    df = Counter(w for bag in bags.values() for w in bag)
    mean = tokens / n - 1
    reached = wanted = 0
    for s, bag in bags.items():
        score = Counter()
        for w in bag:
            if 1 < df[w] <= packing.TERM_DF:
                for d, other in bags.items():
                    if d != s and w in other:
                        part = other[w] * (packing.K1 + 1) / (other[w] + packing.K1 * (1 - packing.B + packing.B * sizes[d] / mean))
                        score[d] += part * np.log((n - df[w] + 0.5) / (df[w] + 0.5))
        top = score.most_common(10)
        wanted += len(top)
        reached += sum(d in got[s] for d, _ in top)
        for d, value in got[s].items():
            assert value / packing.SCORE_PARTS <= score[d] + 0.05
    assert wanted > 1000 and reached >= 0.97 * wanted  # the rest are ties


def test_packing_finds_a_document_by_common_words_alone(spark, monkeypatch):
    """A query is asked with all words, however many documents have them, and in any number of blocks."""
    rng = np.random.default_rng(9)
    topics = [lexicon(rng, 40) for _ in range(4)]  # each word is in a hundred documents
    rows = [(i, " ".join([*topics[i % 4], *lexicon(rng, 60)])) for i in range(1, 400)] + [(1000 + 100 * k, " ".join(topics[k])) for k in range(4)] + [(None, None), (500, "")]
    encoded = packing.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH)
    n, tokens = len(rows), encoded.agg({"doc_tokens": "sum"}).first()[0]
    names = {r.rid: r.doc_id for r in encoded.collect()}
    found = {}
    for size in (packing.BLOCK_IDS, 50):
        monkeypatch.setattr(packing, "BLOCK_IDS", size)
        out = packing.fill_windows(encoded, packing.word_ends(PATH), n, tokens).collect()
        assert sorted(r.rid for r in out) == sorted(names)
        found[size] = {(r.rid, names[r.gid], r.score) for r in out}
        for r in out:
            i = names[r.rid]
            if i and i < 400 and i % 100:
                assert names[r.gid] == 1000 + 100 * (i % 4) and 0 < r.score < float("inf")
            else:
                assert r.gid == r.rid
    assert len({frozenset(x) for x in found.values()}) == 1


def test_packing_finds_the_words_and_lists_of_a_block(monkeypatch):
    """Words with equal upper bits, before the first and after the last one; lists of all lengths."""
    rng = np.random.default_rng(13)
    word = np.unique(np.concatenate([np.arange(5), (1 << 48) - 1 - np.arange(5), rng.integers(0, 1 << 48, 300), (1 << 40) + np.arange(40)]).astype(np.uint64))
    lists = [np.sort(rng.choice(1000, 1 + k % 200, replace=False)) for k in range(len(word))]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    block = packing.Block(np.arange(1000), word, first, np.concatenate(lists), np.arange(len(word)) + 1.0, np.ones(1000))
    asked = np.concatenate([word, word + np.uint64(1), word - np.uint64(1), np.array([7, 1 << 47], np.uint64)]) & np.uint64((1 << 48) - 1)
    hit, at = block.at(asked)
    plain = {w: k for k, w in enumerate(word.tolist())}
    assert dict(zip(hit.tolist(), at.tolist(), strict=True)) == {k: plain[w] for k, w in enumerate(asked.tolist()) if w in plain}
    none = packing.Block(word[:0], word[:0], word[:0], word[:0], word[:0], word[:0])
    assert len(none.at(asked)[0]) == 0
    for dense in (1, 8, 10_000):
        monkeypatch.setattr(packing, "DENSE", dense)
        column, matrix = block.columns()
        table_of, row_of, tables = block.lists(column)
        for k, own in enumerate(lists):
            if len(own) * dense >= 1000:
                assert np.flatnonzero(matrix[column[k]]).tolist() == own.tolist() and set(matrix[column[k], own]) == {k + 1.0}
            else:
                got = tables[table_of[k]][row_of[k]]
                assert column[k] == -1 and got[: len(own)].tolist() == own.tolist() and (got[len(own) :] == 1000).all() and len(got) < 2 * len(own)


def test_packing_asks_the_whole_corpus(spark):
    rng = np.random.default_rng(6)
    plain = [" ".join(lexicon(rng, 30)) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(plain)] + [(1000 + i, t) for i, t in enumerate(plain)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH, window=512).collect()
    of, filled = defaultdict(set), Counter()
    for p in pieces:
        of[p.doc_id].add(p.sequence_id)
        filled[p.sequence_id] += p.length
    assert sum(bool(of[i] & of[1000 + i]) for i in range(100)) >= 95
    assert sum(n < 512 for n in filled.values()) <= 1


def test_packing_lays_large_groups_of_copies_together(spark):
    rng = np.random.default_rng(8)
    groups = [" ".join(lexicon(rng, 20)) for _ in range(3)]
    rows = [(i, groups[i % 3]) for i in range(600)] + [(1000 + i, " ".join(lexicon(rng, 20))) for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, window=512).collect()
    kinds = defaultdict(set)
    for p in pieces:
        kinds[p.sequence_id].add(p.doc_id % 3 if p.doc_id < 1000 else 3)
    assert sum(len(k - {3}) == 1 for k in kinds.values()) >= 0.8 * len(kinds)


def test_windows_open_with_a_group_and_fill_with_who_has_none():
    size, group = np.array([5, 3, 3, 4, 6, 9, 2]), np.array([7, 1, 1, 8, 2, 2, 9])
    table = packing.lay_out(size, group, 8)
    assert table[:, [0, 1, 2]].tolist() == [[1, 0, 3], [2, 0, 3], [0, 0, 2], [4, 0, 6], [5, 0, 2], [5, 2, 7], [0, 2, 1], [0, 3, 2], [3, 0, 4], [6, 0, 2]]
    assert (table[:, 3] * 8 + table[:, 4]).tolist() == [0, 3, 6, 8, 14, 16, 23, 24, 26, 30]
    assert len(packing.lay_out(np.zeros(0, np.int64), np.zeros(0, np.int64), 8)) == 0


# --------------------------------------------------------------- toxicity


def test_toxicity_columns_and_edges(nasty, nothing, labels, no_labels):
    for lab in (labels, no_labels):
        got = toxicity.toxicity(nasty, lab).collect()
        assert len(got) == nasty.count()
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.toxicity(nothing, no_labels).count() == 0
    assert toxicity.keep_clean(nasty, no_labels).columns == nasty.columns


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = toxicity.toxicity(docs, lab).join(lab.where("toxic is not null"), "doc_id").where("held_out")
    assert r.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.95


def test_toxicity_never_reads_held_out_labels(spark):
    rows = [(i, f"plain words number {i % 7} here", 0) for i in range(400)] + [(1000 + i, f"plain idiot words {i % 7}", 1) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    other = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x).orderBy("doc_id").collect() for x in (lab, other))
    assert a == b
    assert all(r.predicted == int(r.doc_id >= 1000) for r in a)


def test_toxicity_sample_is_bounded_with_repeated_rows(spark, monkeypatch):
    rows = spark.range(10_000).selectExpr("id % 5 as doc_id", "concat('some words ', id % 50) as text").unionByName(spark.range(40).selectExpr("100 + id as doc_id", "concat('other idiot words ', id) as text"))
    lab = spark.range(140).selectExpr("id as doc_id", "int(id < 5 or id >= 120) as toxic").unionByName(spark.range(1000).selectExpr("id % 5 as doc_id", "1 as toxic"))
    sizes = []
    train = toxicity.train_nnpu
    monkeypatch.setattr(toxicity, "train_nnpu", lambda positive, unlabelled, *rest: sizes.append((len(positive), len(unlabelled))) or train(positive, unlabelled, *rest))
    model = toxicity.fit(rows, lab, 9, 12)
    assert max(p for p, _ in sizes) <= 9 and max(u for _, u in sizes) <= 12 and len(model.buckets) <= toxicity.FEATURES
    assert toxicity.score(rows, model).count() == 10_040


def test_nnpu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(4)
    code = lambda buckets: np.sort(np.array(buckets, np.int64)) * (toxicity.MOST_COUNT + 1) + 1
    positive = [code([1, *rng.integers(10, 40, 3)]) for _ in range(200)]
    unlabelled = [code([1, *rng.integers(10, 40, 3)] if rng.random() < 0.1 else rng.integers(10, 40, 4)) for _ in range(1500)]
    chosen = np.arange(1, 40)
    w, b = toxicity.train_nnpu(positive, unlabelled, 0.1, chosen, epochs=120)
    assert w[0] + b > 0 > b and w[0] > 3 * w[9:].max()


# ------------------------------------------------------- licenses, quotes


def plain_license(text, df, n):
    """The best cosine of a line, paragraph or whole text, the plain way."""
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    known = {w for _, t in licenses.templates() for w in split(t)}
    idf = lambda w: np.log((1 + n) / (1 + df[w])) + 1 if w in known else np.log((1 + n) / 2) + 1
    vector = lambda t: {w: k * idf(w) for w, k in Counter(split(t)).items()}

    def cosine(a, b):
        size = lambda v: np.sqrt(sum(x * x for x in v.values()))
        return sum(a[w] * b[w] for w in a.keys() & b.keys()) / (size(a) * size(b))

    made = [(name, vector(t)) for name, t in licenses.templates()]
    marker = re.compile("|".join(licenses.MARKERS))
    units = [*text.split("\n"), *re.split(r"\n(?:[^a-z0-9A-Z\x80-\U0010FFFF]*\n)+", text), text]
    best = (0.0, None)
    for unit in units:
        if split(unit) and marker.search(" ".join(split(unit))):
            for name, v in made:
                c = cosine(vector(unit), v)
                if c >= licenses.THRESHOLD and c > best[0] + 1e-12:
                    best = (c, name)
    return best


PROSE = "some words of prose about nothing in particular that go on for a while"
MIT_TEXT = dict(licenses.templates()[::-1])["MIT"]


def license_rows():
    full = {}
    for name, text in licenses.templates():
        if len(text) > 500:
            full[name] = text
    mit = full["MIT"].replace("<year> <copyright holders>", "2021 Jane Example and others")
    header = "#!/bin/sh\n#\n# " + "\n# ".join(
        ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    )
    apache = "/*\n * Copyright 2020 Someone\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\n"
    texts = [mit, full["Apache-2.0"], full["GPL-3.0"], full["BSD-3-Clause"], full["BSD-2-Clause"], full["MPL-2.0"]]
    return [*texts, header + "\n\n" + (PROSE + "\n") * 30, apache + (PROSE + "\n") * 30, PROSE, "the license of this prose is a matter of permission, " + PROSE, "// SPDX-License-Identifier: MIT\n" + PROSE * 5, None, ""]


def test_license_texts_and_headers_are_found(spark):
    rows = [(i, t) for i, t in enumerate([*license_rows(), *[PROSE] * 200])]
    got = {r.doc_id: r for r in licenses.scan(licenses.with_paths(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()}
    names = ["MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "GPL-3.0", "Apache-2.0", None, None, "MIT", None, None]
    assert [got[i].own_license for i in range(13)] == names
    assert [got[i].is_file for i in range(13)] == [True] * 6 + [False] * 7
    df = Counter(w for _, t in rows for w in set(licenses.words_of(t or "")))
    for i, t in rows[:13]:
        cosine, name = plain_license(t or "", df, len(rows))
        assert abs(cosine - got[i].cosine) < 1e-9 and name == got[i].own_license


def test_paths_of_ids_are_nested(spark):
    ids = spark.createDataFrame([(1234,), (1230,), (1200,), (7,), (0,), (None,)], "doc_id long")
    assert [r.path for r in licenses.with_paths(ids).collect()] == ["1/2/3/1234.txt", "1/2/1230.txt", "1/1200.txt", "7.txt", "0.txt", None]
    given = spark.createDataFrame([(1, "a/b")], "doc_id long, path string")
    assert licenses.with_paths(given).first().path == "a/b"


def test_license_inheritance_from_the_nearest_directory(spark, nothing):
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"), (2, "code", "a/x.c"), (3, "code", "a/b/y.c"), (4, "Licensed under CC BY-NC 4.0.", "a/b/LICENSE"), (5, "code", "a/b/c/z.c"),
        (6, "code", "d/q.c"), (7, "code\nReleased under the MIT License.\n" + "code " * 50, "a/b/own.c"), (8, None, None), (9, "", "a/"), (2, "code", "a/x.c"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.license, r.inherited_from) for r in got}
    assert found == {
        1: ("MIT", None), 2: ("MIT", "a"), 3: ("CC-BY-NC-4.0", "a/b"), 4: ("CC-BY-NC-4.0", None), 5: ("CC-BY-NC-4.0", "a/b"),
        6: (None, None), 7: ("MIT", None), 8: (None, None), 9: ("MIT", "a"),
    }
    assert licenses.scan(nothing.withColumn("path", F.lit("a/b"))).count() == 0


def test_only_license_files_speak_for_a_directory(spark):
    full = {name: text for name, text in licenses.templates() if len(text) > 500}
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n"
    tree = {  # path: text, license, directory it comes from
        "LICENSE": (full["MIT"], "MIT", None),
        "readme.md": (PROSE, "MIT", ""),
        "src/a.py": (apache + "run()\n" * 3, "Apache-2.0", None),  # a header of most of its words
        "src/b.py": (PROSE, "MIT", ""),
        "src/deep/c.py": (PROSE, "MIT", ""),
        "src/deep/d.py": ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0", None),  # nothing but a tag
        "src/deep/e.py": (PROSE, "MIT", ""),
        "lib/COPYING.txt": ("GNU General Public License version 3", "GPL-3.0", None),  # short, but by its name
        "lib/f.c": (PROSE, "GPL-3.0", "lib"),
        "lib/inner/g.c": (PROSE, "GPL-3.0", "lib"),
        "lib/inner/h.c": (apache + PROSE, "Apache-2.0", None),
        "lib/inner/i.c": ("", "GPL-3.0", "lib"),
        "vendor/x/legal": (full["BSD-3-Clause"], "BSD-3-Clause", None),  # by its text
        "vendor/x/j.c": (PROSE, "BSD-3-Clause", "vendor/x"),
        "vendor/k.c": (PROSE, "MIT", ""),
        "vendor/x/y/z/l.c": (None, "BSD-3-Clause", "vendor/x"),
        "vendor/y/LICENCE": (PROSE, "MIT", ""),  # the name alone is no license
        "vendor/y/m.c": (PROSE, "MIT", ""),
        "vendor/y/licenses/n.c": (apache + PROSE, "Apache-2.0", None),  # a folder's name is no file's
        "vendor/y/licenses/o.c": (PROSE, "MIT", ""),
    }
    rows = [(i, text, path) for i, (path, (text, _, _)) in enumerate(tree.items())]
    got = {r.path: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {path: (name, place) for path, (_, name, place) in tree.items()}


def test_a_header_has_no_heirs(spark):
    header = "# Licensed under the Apache License, Version 2.0.\nimport x\nrun(x)\n"
    rows = [(0, header, "a/s.py"), *((i, "code " * 9, f"a/{i}.py") for i in range(1, 201))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"))
    assert got.where("license is not null").count() == 1


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "bot", "> hello  THERE\n> How are you?\nFine, thanks."), (1, 2, "user", "> > Hello there\n> > How are you?\n> Fine, thanks.\nGood.\n\nAnd now?"),
        (1, 3, "x", "> and now?\nNothing"), (1, 4, "y", "> never said\nhm"), (2, 0, "u", "> Hello there\n> How are you?\nme too"), (2, 1, "u", None), (None, 1, "u", "x"), (1, 3, "x", "> and now?\nNothing"), (3, 0, "u", ""), (3, 1, "u", ">\n>>\n"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link_quotes(df).collect()
    found = {(r.conv_id, r.turn): (r.body, r.n_quoted, r.n_linked, r.parent_turn, r.thread_turn, r.origin_conv, r.origin_turn) for r in got}
    assert len(got) == len(rows)
    assert found[1, 1] == ("Fine, thanks.", 1, 1, 0, 0, 1, 0)
    assert found[1, 2] == ("Good.\n\nAnd now?", 2, 2, 1, 0, 1, 0)
    assert found[1, 3] == ("Nothing", 1, 1, 2, 0, 1, 2)
    assert found[1, 4] == ("hm", 1, 0, None, 4, None, None)
    assert found[2, 0] == ("me too", 1, 0, None, 0, 1, 0)
    assert found[2, 1] == ("", 0, 0, None, 1, None, None)
    assert found[None, 1] == ("x", 0, 0, None, 1, None, None)
    assert quotes.link_quotes(df.where("turn < 0")).count() == 0
    same_as_sql(df)


def same_as_sql(df):
    import duckdb

    got = quotes.link_quotes(df).collect()
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    cursor = con.execute(quotes.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    assert Counter(tuple(r[names.index(c)] for c in got[0].asDict()) for r in cursor.fetchall()) == Counter(map(tuple, got))
    return {(r.conv_id, r.turn): r for r in got}


def test_parts_of_quotes_are_linked(spark):
    said = "First line here.\nSecond line here.\nThird line here.\n\nAnother paragraph\nof two lines."
    rows = [
        (1, 0, "u", said), (1, 1, "u", "Something else.\nSecond line here."),
        (1, 2, "u", "> First line here.\n> Second line here.\ntwo of three"), (1, 3, "u", "> Third line here.\n>\n> Another paragraph\n> of two\ntrimmed"),
        (1, 4, "u", "> Another paragraph\n> of two lines.\nfine"), (1, 5, "u", "> > > First line here.\n> > trimmed\n> hm\ndeep"), (1, 5, "u", "another text of this turn"),
        (2, 0, "u", "> Second line here.\nstranger"),
    ]
    got = same_as_sql(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [got[1, t].parent_turn for t in range(6)] == [None, None, 0, 0, 0, 3]
    assert (got[1, 5].n_quoted, got[1, 5].n_linked) == (3, 2) and (got[2, 0].origin_conv, got[2, 0].origin_turn) == (1, 0)
    assert [got[1, t].position for t in range(6)] == [0, 5, 1, 2, 4, 3]


def test_reply_order_of_long_chains_and_wide_trees(spark):
    rng = np.random.default_rng(9)
    parent = {(1, t): t - 1 if t else None for t in range(200)} | {(2, t): None for t in range(100)} | {(3, t): int(rng.integers(0, t)) if t % 7 else None for t in range(150)}
    df = spark.createDataFrame([(c, t, p) for (c, t), p in parent.items()], "conv_id long, turn long, parent_turn long")
    got = {(r.conv_id, r.turn): r.position for r in quotes.reply_order(df).collect()}
    for c in (1, 2, 3):
        order = []

        def visit(t, c=c, order=order):
            stack = [t]
            while stack:
                x = stack.pop()
                order.append(x)
                stack += sorted((k for (d, k), p in parent.items() if d == c and p == x), reverse=True)

        for root in sorted(t for (d, t), p in parent.items() if d == c and p is None):
            visit(root)
        assert [got[c, t] for t in order] == list(range(len(order)))


def test_quotes_of_a_table_with_replies(spark):
    df = quotes.with_replies(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    got = same_as_sql(df)
    assert sum(r.n_linked for r in got.values()) >= 0.9 * sum(r.n_quoted for r in got.values()) > 10


# --------------------------------------------------------------- pipeline


def test_pipeline_stages_agree_with_their_operators(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lab = spark.read.parquet(f"{d}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = corpus_pipeline.toxicity(spark, docs, d)
    assert clean.columns == docs.columns
    assert ids(clean) == ids(toxicity.toxicity(docs, lab).where("predicted = 0"))
    good = corpus_pipeline.quality(spark, clean, d)
    assert ids(good) == ids(quality.judge(clean, lab).where("kept"))
    kept = corpus_pipeline.near_dedup(spark, good, d)
    assert ids(kept) == plain_firsts([(r.doc_id, r.text) for r in good.collect()])
    clear = corpus_pipeline.secrets(spark, kept, d)
    assert clear.columns == docs.columns and ids(clear) == ids(kept)
    pieces = defaultdict(list)
    for p in corpus_pipeline.run(spark, d).collect():
        pieces[p.doc_id].append((p.start, p.ids))
    library_ids = Tokenizer.from_file(PATH)
    want = {r.doc_id: [*library_ids.encode(r.text or "", add_special_tokens=False).ids, 1] for r in clear.collect()}
    assert {i: np.frombuffer(b"".join(x for _, x in sorted(parts)), "<u4").tolist() for i, parts in pieces.items()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "secrets", "packing"]


def plain_firsts(rows):
    """The first ``doc_id`` of each group of near copies (five words, 0.8), by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    first = {i: i for i in sets}

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                first[max(a, b)] = min(a, b)
    return sorted(i for i in sets if root(i) == i)


def test_pipeline_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    made = []
    stage = lambda name: (name, lambda spark, docs, sf_dir: made.append(name) or docs.where("doc_id % 7 <> 0"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    folder, d = str(tmp_path / "run"), "/root/testdata/sf0.001"
    n = corpus_pipeline.run(spark, d, folder).count()
    (tmp_path / "run" / "c" / "_SUCCESS").unlink()
    assert corpus_pipeline.run(spark, d, folder).count() == n > 0 and made == ["a", "b", "c", "c"]
    assert corpus_pipeline.run(spark, d).count() == n and made[4:] == ["a", "b", "c"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
