"""The corpus operators against brute force, on the small tables and on rows made to be awkward."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import chat, common, decontaminate, induced, langid, minhash, mixing, pii, queries, sharding, suffix, topk, warc
from lamina.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, rid long, MARK string, Shard string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 400
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", "a"), (5, "one two", "en", "a"), (6, "ONE two", "en", "b"),
    (7, LONG, "en", "b"), (7, LONG, "en", "b"), (8, LONG + " tail", "en", "b"), (None, LONG, "en", "b"), (None, None, None, None), (9, "é" * 60 + " Ü x\0y " + "é" * 60, "fr", "c"),
    (10, "x " + "é" * 60, "fr", "c"), (11, "a" * 5000, "xx", "c"), (12, "a" * 4000 + "b", "xx", "c"), (13, "\U0001f600 \U0001f600 z", None, "c"), (14, "12345 --", "en", "c"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, lang, s, len(t or ""), 1, "m", "s") for i, t, lang, s in AWKWARD]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def table(df):
    return [r.asDict() for r in df.collect()]


# --- sharding


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_shards(request, which):
    src = request.getfixturevalue(which)
    got, texts = table(sharding.shard_table(src)), [(r.doc_id, r.text) for r in src.collect()]
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by, sizes = defaultdict(list), Counter()
    for r in got:
        by[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    if which == "docs":
        assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in got)
    kept = sharding.shard_documents(src)
    assert kept.count() == len(texts) and kept.columns == [c for c in src.columns if c != "Shard"] + ["vslot", "shard"]


def test_heavy_keys_are_dealt(spark):
    """A row that is repeated over and over is no slot's alone."""
    rows = [(None, None)] * 3000 + [(5, "x" * 50)] * 2000 + [(i, f"text {i}") for i in range(3000)]
    src = spark.createDataFrame(rows, "doc_id long, text string")
    got = table(sharding.shard_table(src, slots=256))
    per, sizes, by = Counter(r["vslot"] for r in got), Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        by[r["shard"]].append(r["slot"])
    assert max(per.values()) < 100 and len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    heavy = Counter(r.shard for r in sharding.shard_documents(src, slots=256).where("doc_id is null").collect())
    assert len(heavy) == 8 and max(heavy.values()) < 1000


def test_maps_are_edited_by_the_next_run(spark, tmp_path):
    maps = sharding.SlotMaps(spark, f"file://{tmp_path}/maps")
    rows = [(i, "x" * (i % 300)) for i in range(4000)]
    one = {r.doc_id: r.shard for r in sharding.shard_documents(spark.createDataFrame(rows[:3000], "doc_id long, text string"), 8, 512, maps).collect()}
    assert maps.versions() == [0]
    sharding.shard_documents(spark.createDataFrame(rows[:3000], "doc_id long, text string"), 8, 512, maps)
    assert maps.versions() == [0]  # nothing to move
    two = {r.doc_id: r.shard for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 9, 512, maps).collect()}
    assert maps.versions() == [0, 1] and {to for i, to in two.items() if i in one and one[i] != to} == {8}
    old, new = ({r.vslot: r.shard for r in maps.load(v).collect()} for v in (0, 1))
    assert {s for s in old if old[s] != new[s]} and all(new[s] == 8 for s in old if old[s] != new[s])
    with pytest.raises(ValueError, match="fixed"):
        sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, 256, maps)


def test_slot_map_edits(spark, tmp_path):
    loads = {s: (s * 37) % 101 + 1 for s in range(500)}
    first = sharding.assign(loads, 8)
    grown = sharding.rebalance(first, loads, 9)
    totals = Counter()
    for s, to in grown.items():
        totals[to] += loads[s]
    assert max(totals.values()) - min(totals.values()) <= 0.02 * sum(loads.values()) / 9 + 101
    assert all(to == 8 for s, to in grown.items() if first[s] != to)  # only into the new shard
    assert set(sharding.rebalance(grown, loads, 7).values()) == set(range(7))
    maps = sharding.SlotMaps(spark, str(tmp_path / "maps"))
    maps.save(first, 0), maps.save(grown, 1)
    assert dict(map(tuple, maps.load(0).collect())) == first and dict(map(tuple, maps.load(1).collect())) == grown


# --- near duplicates


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_groups(rows, width, pct):
    words = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) for _, t in rows]
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        c = min(known) if known else None
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


@pytest.mark.parametrize(("which", "width", "pct"), [("docs", 3, 85), ("docs", 5, 80), ("awkward", 3, 85), ("empty", 3, 85)])
def test_near_duplicates(request, which, width, pct):
    src = request.getfixturevalue(which)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in table(minhash.near_duplicates(src, width, pct)))
    assert got == brute_groups([(r.doc_id, r.text) for r in src.collect()], width, pct)


def test_links_between_clusters(spark):
    """A chain of texts, each near the next only, and two clusters that share buckets but only two of whose members are near."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(1000 - k, " ".join(base[4 * k : 260 + 4 * k])) for k in range(10)]
    star = [f"v{x}" for x in rng.integers(0, 10**6, 200)]
    for k in range(40):
        w = list(star)
        for i in rng.integers(0, 200, 4):
            w[i] = f"u{rng.integers(10**6)}"
        rows.append((2000 + k, " ".join(w)))
    src = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in table(minhash.near_duplicates(src, 3, 85)))
    assert got == brute_groups(rows, 3, 85)


def thue_morse(n, flip=0):
    return [(bin(i).count("1") + flip) % 2 for i in range(n)]


def test_links_are_verified_on_words(spark):
    """Words that cancel in any polynomial modulo 2^64 stay two words; also where everything is shuffled."""
    one, two = ("".join("ab"[x] for x in thue_morse(1024, flip)) for flip in (0, 1))
    rows = [(1, one), (2, two), (3, one.upper()), (4, f"{two} x"), (5, f" {two}\tX ")]
    src = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (minhash.BROADCAST_ROWS, 0):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in table(minhash.near_duplicates(src, 3, 85, broadcast_rows=limit)))
        assert got == brute_groups(rows, 3, 85) and {k[2] for k in got} == {1, 2, 4}


def test_overlaps_of_words():
    words = lambda t: t.lower().split()
    texts = ["a b c d e", "a b c d f", "a b", "b a", "", "a b c a b c a b c", "A B C a b c", "x " * 50 + "y"]
    for width in (3, 5):
        shingles = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in map(words, texts)]
        for i, a in enumerate(texts):
            one = minhash.Exact(a.encode(), width)
            for j, b in enumerate(texts):
                assert one.overlap(b.encode()) == (len(shingles[i] & shingles[j]), len(shingles[i] | shingles[j])), (a, b)
    long = ("w%d " * 3000) % tuple(range(3000))
    (short_cut, digest), = minhash.shingle_sets([long.encode()], 3)
    whole = [w for part in minhash.words(long.encode(), 100) for w in part]
    assert whole == long.encode().split() and len(short_cut) == 2998


def test_one_row_of_each_group_stays(awkward, empty):
    for limit in (minhash.BROADCAST_ROWS, 0):
        left = table(minhash.drop_near_duplicates(awkward, 5, 80, broadcast_rows=limit))
        assert Counter(r["doc_id"] for r in left) == Counter([1, 2, 3, 4, 5, 7, None, 9, 10, 11, 12, 13, 14])
    assert minhash.drop_near_duplicates(empty).count() == 0
    assert minhash.drop_near_duplicates(awkward).columns == awkward.columns


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(500, i) for i in range(400, 600)] + [(700, 701), (701, 700), (9, 9)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{i: 400 for i in range(400, 600)}, 700: 700, 701: 700}


def test_bounds():
    bands, rows = minhash.bands_for(0.85)
    assert (1 - 0.85**rows) ** bands <= 1e-6 and bands * rows <= minhash.HASHES
    for n, m in minhash.least_matches(0.85, 1e-9):
        tail = lambda m, n=n: sum(math.comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(m + 1))
        assert tail(m) >= 1e-9 and (m == 0 or tail(m - 1) < 1e-9)


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/é%41\r\nX: y", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 200_000), (None, "u", "<p>é"), (6, "v", "<p>é"), (6, "v", "<p>é"), (None, None, "lone")]
    src = spark.createDataFrame([(*p, 0, "f") for p in pages], "page_id long, url string, html string, offset int, file string").repartition(3)
    index = warc.write_archives(src, f"file://{tmp_path}/w", archive_bytes=300)
    got = table(warc.read_records(index))
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((i, u) for i, u, _ in pages)
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[(h or "").encode()].append(i)
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        least = min((x for x in groups[body] if x is not None), default=None)
        kind = "response" if i == least else "revisit"
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, None if i == least else least, body if i == least else None))
    key = lambda r: str(r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in got), key=key) == sorted(want, key=key)
    some = table(warc.read_records(index.where("page_id = 5"), payloads=True))
    assert len(some) == 1 and some[0]["payload"] == b"x" * 200_000
    assert warc.archive_pages(spark.createDataFrame([], src.schema)).count() == 0
    assert len(warc.coalesced([("a", 0, 10), ("a", 12, 5), ("a", 99, 1), ("b", 0, 1)], gap=4)) == 3


# --- PII

KEY = "of the tests"


def test_names_without_titles(spark):
    texts = [
        (1, "Mary Stone met Dr. John Stone, John Stone and Mr. John Stone."), (2, "Prof. Anna-Maria von der Heide left."), (3, "Mary had a lamb. Johnny Stone, MARY STONE, Mark my words"), (4, "Ольга Иванова и Иван Иванов"),
        (5, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE88 3704 0044 0532 0130 00"), (6, "+44 20 7946 0958, +1 (017) 555-7713, 078-05-1120, 666-12-1234"),
    ]
    got = {r["doc_id"]: r["text"] for r in table(pii.replace_pii(spark.createDataFrame(texts, "doc_id long, text string"), KEY))}
    names = re.fullmatch(r"(\w+na) (\w+) met Dr\. (\w+ron) (\w+), (\w+ \w+) and Mr\. (\w+ \w+)\.", got[1])
    assert names and names[5] == names[6] == f"{names[3]} {names[4]}" and not {"Mary", "Stone", "John"} & set(re.findall(r"\w+", got[1]))  # one person, with a title or not
    assert re.fullmatch(r"Prof\. \w+na-\w+ [a-z]+ [a-z]+ [A-Z]\w+ left\.", got[2]) and "Heide" not in got[2]
    assert got[3] == texts[2][1] and re.fullmatch(r"[А-Я][а-я]+на [А-Я][а-я]+ и [А-Я][а-я]+рон [А-Я][а-я]+", got[4]) and "Иванов" not in got[4]
    found = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) and (GB\d\d[A-Z]{4}\d{14}) and (DE\d\d(?: \d{4}){4} \d\d)", got[5]).groups()
    rest = lambda x: int("".join(str(int(c, 36)) for c in x.replace(" ", "")[4:] + x[:4])) % 97
    assert [rest(x) == 1 for x in found] == [True, True, False] and not any(x in texts[4][1] for x in found)
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}, \+1 \(\d{3}\) \d{3}-\d{4}, \d{3}-\d\d-\d{4}, \d{3}-\d\d-\d{4}", got[6])
    for area, group, serial in re.findall(r"(\d{3})-(\d\d)-(\d{4})", got[6].split(", ", 2)[2]):
        assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    with pytest.raises(ValueError, match="key"):
        pii.replace_pii(spark.createDataFrame(texts, "doc_id long, text string"), "")


def test_seeds_are_a_mac(spark):
    import hmac

    for key in ("short", "long " * 40):
        got = spark.range(1).select(pii._mac(F.lit("a\u0001é"), key)).first()[0]
        assert got == hmac.new(key.encode(), "a\u0001é".encode(), "sha256").hexdigest()


@pytest.mark.parametrize("limit", [pii.BROADCAST_ROWS, 0])
def test_whole_table_is_replaced(spark, small, limit):
    """Every text equals the original with each entity, found by another regex engine, put for one that is its own and no other's."""
    src = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    any_ = regex.compile(pii.ANY, regex.V0)
    by, real = {}, set()
    texts = {r.doc_id: r.text for r in src.collect()}
    n = 0
    for r in pii.replace_pii(src, KEY, limit).collect():
        spans = [m.span() for m in any_.finditer(texts[r.doc_id])]
        assert r.n_entities == len(spans), r.doc_id
        at = here = 0
        ends = [*(a for a, _ in spans[1:]), None][: len(spans)]
        for (a, e), nxt in zip(spans, ends, strict=True):
            assert r.text[here : here + a - at] == texts[r.doc_id][at:a]
            here += a - at
            entity, tail = texts[r.doc_id][a:e], texts[r.doc_id][e:nxt]
            if entity not in by:  # ends where what follows the entity begins
                size = next(k for k in range(1, len(entity) + 60) if r.text[here + k :].startswith(tail if nxt is not None else tail) and (nxt is not None or here + k + len(tail) == len(r.text)))
                by[entity] = r.text[here : here + size]
            assert r.text[here:].startswith(by[entity])
            here, at, n = here + len(by[entity]), e, n + 1
            real.add(entity)
        assert r.text[here:] == texts[r.doc_id][at:]
    assert n > 100 and len(set(by.values())) == len(by) and not set(by.values()) & real


def test_surrogates(spark):
    texts = [
        (1, "Mail Anna.Lee@corp.example.org or anna.lee@corp.example.org, not bob@corp.example.org."), (2, "from anna.lee@corp.example.org at 10.20.30.40; 10.20.30.40 and 10.20.30.41"),
        (3, "card 4111 1111 1111 1111 = 4111111111111111, other 4111111111111112, call +1 (017) 555-7713"), (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ssn 078-05-1120'),
        (5, "Mrs. Mary Stone met Mr. John Stone and Frau Müller; Mrs. Mary Stone left; Госпожа Иванова"), (6, "Nothing here: 12 of 34, v1.2.3.4.5, 2024-01-01."), (7, None), (7, ""), (None, "é.x@y.example.com"), (8, "é.x@y.example.com é.x@y.example.com"),
    ]
    src = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, found int")
    got = {(r["doc_id"], i): r for i, r in enumerate(sorted(table(pii.replace_pii(src, KEY)), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None)))}
    by = {k[0]: r for k, r in got.items()}
    assert by[6]["text"] == texts[5][1] and by[6]["n_entities"] == 0
    mails = re.findall(r"[\w.]+@[\w.]+\w", by[1]["text"])
    assert mails[0].lower() == mails[1].lower() and mails[0] != mails[1] and mails[2].lower() != mails[0].lower() and mails[0].endswith(".org") and mails[0][0].isupper()
    assert mails[1] in by[2]["text"] and "anna" not in by[2]["text"]
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", by[2]["text"])
    assert ips[0] == ips[1] != ips[2] and all(0 <= int(x) <= 255 for ip in ips for x in ip.split("."))
    spaced, plain, other = re.search(r"card (.{19}) = (\d{16}), other (\d{16})", by[3]["text"]).groups()
    luhn = lambda c: sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(c))) % 10
    assert spaced.replace(" ", "") == plain != other and luhn(plain) == 0 and luhn(other) != 0 and plain[0] == "4" and "4111" not in by[3]["text"]
    assert re.search(r"call \+\d \(\d{3}\) \d{3}-\d{4}$", by[3]["text"]) and "7713" not in by[3]["text"]
    assert re.search(r'token = "[0-9a-f]{40}" ssn \d{3}-\d\d-\d{4}$', by[4]["text"]) and "04dbebab" not in by[4]["text"] and "1120" not in by[4]["text"]
    names = re.match(r"(Mrs\. (\w+) \w+) met Mr\. (\w+) \w+ and Frau \w+; (Mrs\. \w+ \w+) left; Госпожа ([а-яА-Я]+)$", by[5]["text"])
    assert names and names[1] == names[4] and names[2].endswith("na") and names[3].endswith("ron") and "Stone" not in by[5]["text"]
    assert len(got) == len(texts) and by[8]["text"].split()[0] == by[8]["text"].split()[1] == by[None]["text"]
    assert pii.replace_pii(src.limit(0), KEY).count() == 0


def test_surrogates_stay_distinct(spark):
    """All one-digit addresses: drawn from their own small layout until none collides, and none is another's true value."""
    rows = [("ip", f"{a}.{b}.{c}.1") for a in range(1, 5) for b in range(10) for c in range(10)]
    got = table(pii.distinct_surrogates(spark.createDataFrame(rows * 2, "kind string, canon string"), KEY))
    values = {r["value"] for r in got}
    assert len(got) == len(values) == 400 and not values & {c for _, c in rows}


def test_exhausted_layouts_widen(spark):
    """More entities than their layout has values, and letters that have no class of their own."""
    az = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{a}@{b}.com") for a in az for b in az] + [("person", f"f:{a}") for a in az] + [("email", "田中@日本.jp")]
    got = table(pii.distinct_surrogates(spark.createDataFrame(rows, "kind string, canon string"), KEY).withColumn("spelled", pii.spell(F.col("kind"), F.when(F.col("kind") == "person", F.concat(F.lit("Ms. "), F.upper(F.substring("canon", 3, 9)))).otherwise(F.col("canon")), F.col("value"))))
    values = [r["value"] for r in got]
    assert len(values) == len(set(values)) == len(rows) and not set(values) & {c for _, c in rows}
    for r in got:
        assert re.fullmatch(r"[a-z]+@[a-z]+\.(com|jp)", r["spelled"]) and r["spelled"] == r["value"] if r["kind"] == "email" else re.fullmatch(r"Ms\. [A-Z][a-z]*", r["spelled"]), r


def test_secrets_of_letters_alone(spark):
    """Replaced also where the text holds no digit, @ or title, and as in a text that does."""
    keys = ["sk-" + "aBcDeFgHiJ" * 2, "ghp_" + "aBcDeF" * 6, "AKIA" + "QRSTUVWX" * 2, "abcdef" * 6, "ABCDEF" * 6]
    rows = [(2 * n + d, f"the key {k} is{' 7' * d} here") for n, k in enumerate(keys) for d in (0, 1)]
    got = {r["doc_id"]: r for r in table(pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), KEY))}
    for n, k in enumerate(keys):
        alone, beside = got[2 * n], got[2 * n + 1]
        assert alone["n_entities"] == beside["n_entities"] == 1 and k not in alone["text"], k
        assert beside["text"] == alone["text"].replace(" is ", " is 7 "), k


def test_long_secrets(spark):
    """However long a key is, it is replaced whole."""
    keys = [c * n for c, n in (("0a", 64), ("0a", 65), ("0A", 3000))] + [f"{p}{'aB3' * n}" for p, n in (("sk-", 22), ("sk-", 9000), ("ghp_", 40))]
    rows = [(n, f"key {k} end") for n, k in enumerate(keys)]
    for r in table(pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), KEY)):
        k = keys[r["doc_id"]]
        value = r["text"].removeprefix("key ").removesuffix(" end")
        assert r["n_entities"] == 1 and r["kinds"] == ["secret"] and len(value) == len(k) and k[4:24] not in value, k[:9]


def test_titled_names_go_whole(spark):
    """No part of a name stays, what follows it does, and layout, case and identity are kept."""
    capital, word = r"[A-Z]\w+", r"[A-Z][a-z]+"
    cases = [
        ("Mr. McDonald came", rf"Mr\. {word} came"), ("Mrs. Anne-Marie Smith came", rf"Mrs\. {word}-{word} {word} came"), ("Mr. Juan Carlos Garcia came", rf"Mr\. {word} {word} {word} came"),
        ("Mr. O'Brien came", rf"Mr\. [A-Z]'{word} came"), ("Mr. O’Brien’s dog", rf"Mr\. [A-Z]’{word}’s dog"), ("Mr. SMITH came", r"Mr\. [A-Z]{5,} came"), ("Mr. Smith's dog", rf"Mr\. {word}'s dog"),
        ("Mr. J. R.R. Tolkien came", rf"Mr\. [A-Z]\. [A-Z]\.[A-Z]\. {word} came"), ("Mr. Stone Mrs. Lee came", rf"Mr\. {word} Mrs\. {word} came"), ("Frau Dr. Merkel kam", rf"Frau {word}\. {word} kam"),
        ("Ms. Juana de la Cruz came", rf"Ms\. {word} [a-z]+ [a-z]+ {word} came"), ("Mr. " + "Aaa " * 2000 + "came", rf"Mr\. (?:{word} ){{2000}}came"), ("Mr. Smith. The end", rf"Mr\. {word}\. The end"),
    ]
    got = {r["doc_id"]: r for r in table(pii.replace_pii(spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "doc_id long, text string"), KEY))}
    for n, (t, shape) in enumerate(cases):
        mine = got[n]["text"]
        assert re.fullmatch(shape, mine), (t[:40], mine[:60])
        assert set(re.findall(capital, t)) & set(re.findall(capital, mine)) <= {"Mr", "Mrs", "Ms", "Frau", "The"}, (t[:40], mine[:60])
    assert got[3]["text"].split()[1][2:] == got[4]["text"].split()[1][2:-2] and got[5]["text"].split()[1] == got[6]["text"].split()[1][:-2].upper()


def test_clean_documents_keep_their_text(docs):
    seen = {r["doc_id"]: r for r in table(pii.replace_pii(docs, KEY))}
    for r in docs.collect():
        mine = re.search(r"[\w.]+@\w|\d{13}|\d\.\d+\.\d+\.\d|\(\d{3}\)|[0-9a-f]{40}", r.text)
        assert (seen[r.doc_id]["n_entities"] > 0) == bool(mine), (r.doc_id, mine)
        assert mine or seen[r.doc_id]["text"] == r.text


# --- decontamination


def brute_hits(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[k : k + window])].add(str(i))
    out = Counter()
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_decontamination(spark, small, docs, awkward, empty, broadcast_bytes):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    odd = spark.createDataFrame([(1, "Kappa lambda", 1), (2, "ONE two", 1), (22, "one TWO", 1), (3, None, 1), (4, "--", 1), (5, "lambda mu alpha beta gamma delta epsilon zeta eta theta iota kappa", 1), (None, "é" * 60, 1)], "item_id long, text string, hash int")
    for src, b in [(docs, bench), (awkward, odd), (empty, bench), (docs, bench.limit(0))]:
        got = Counter(tuple(r) for r in decontaminate.decontamination_report(src, b, broadcast_bytes=broadcast_bytes).collect())
        items = [(r.item_id, r.text) for r in b.collect() if r.item_id is not None]
        if b is odd:  # an item without id still hits, but has no name
            got = Counter({k[:3] + (0,) * 3: n for k, n in got.items()}) and Counter(tuple(r)[:3] for r in decontaminate.decontamination_report(src, b, broadcast_bytes=broadcast_bytes).collect())
            want = Counter()
            for k, n in brute_hits([(r.doc_id, r.text) for r in src.collect()], [(r.item_id, r.text) for r in b.collect()]).items():
                want[k[:3]] += n
            assert got == want
        else:
            assert got == brute_hits([(r.doc_id, r.text) for r in src.collect()], items)


def test_contaminated_documents_go(spark, small, docs, awkward, empty):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    hit = {k[0] for k in brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]) if k[5]}
    left = decontaminate.drop_contaminated(docs, bench)
    assert hit and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.collect()} - hit and left.columns == docs.columns
    odd = bench.unionByName(spark.createDataFrame([(99, "kappa lambda mu alpha beta gamma delta epsilon zeta eta theta iota")], "item_id long, text string"))
    for rows in (decontaminate.BROADCAST_ROWS, 0):
        left = decontaminate.drop_contaminated(awkward, odd, broadcast_rows=rows)
        assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, t, *_ in AWKWARD if t is None or "kappa" not in t)
    assert decontaminate.drop_contaminated(empty, bench).count() == 0 and decontaminate.drop_contaminated(awkward, bench.limit(0)).count() == len(AWKWARD)
    report = {r.doc_id: r for r in decontaminate.decontamination_report(docs, bench).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in decontaminate.remove_spans(docs, bench).collect():
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.clean_text)) == report[r.doc_id].n_words - report[r.doc_id].n_hit
        assert report[r.doc_id].n_hit or r.clean_text == texts[r.doc_id]
    item = "One two three four five six seven eight nine ten eleven."
    rows = [(1, f"  «A» {item.upper()} B, c! {item}  Two (three) end. "), (2, item), (3, None), (4, "!?"), (5, "one two three")]
    clean = {r.doc_id: r.clean_text for r in decontaminate.remove_spans(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "Two three")], "item_id long, text string")).collect()}
    assert clean == {1: "  «A» B, c! end. ", 2: "", 3: None, 4: "!?", 5: "one "}


# --- mixing


def chained(*values):
    """The hash of several columns as the JVM takes it: each is hashed with the hash so far as seed; null leaves it."""
    h = 42
    for v, size in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(size, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def brute_mix(rows, repetition, budget=None, seed=17, blocks=256):
    """Counter of (doc_id, source, n_tokens, epoch, block) and the order of each epoch, drawn one document after the other."""
    docs = [(d, s, len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")), chained((seed, 4), (d, 8), (t, 0))) for d, t, s in rows]
    by = defaultdict(list)
    for d, s, n, k in docs:
        by[s].append((d, n, k))
    total = {s: sum(n for _, n, _ in x) for s, x in by.items()}
    p = {s: n / sum(total.values()) for s, n in total.items() if n}
    spread = lambda a: round(max(x ** (a - 1) for x in p.values()) / min(x ** (a - 1) for x in p.values()), 9)
    low, high = 0.0, 1.0
    if spread(0.0) <= repetition:
        high = 0.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if spread(mid) <= repetition else (mid, high)
    return by, total, p, high, docs


@pytest.mark.parametrize("budget", [None, 4000])
def test_mixing_draws(spark, budget):
    """Every draw and its place equals a draw by hand, from weights that the operator reports and that are checked here."""
    rng = np.random.default_rng(2)
    rows = [(int(i), "w " * int(rng.integers(0, 9)), "big" if i % 10 else f"s{i % 3}") for i in range(1500)] + [(5000, None, "none"), (5001, "", None), (None, "a b", "s1"), (7, "w w", "s1"), (7, "w w", "s1")]
    src = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by, total, p, a, docs = brute_mix(rows, 2.5, budget)
    got = table(mixing.mix(src, 2.5, budget=budget, blocks=8))
    weight = {r["source"]: r["weight"] for r in got}
    z = sum(x**a for x in p.values())
    assert all(weight[s] == pytest.approx(x**a / z, rel=1e-4) for s, x in p.items())
    whole = budget if budget is not None else max(total[s] / weight[s] for s in p)
    want = Counter()
    for s, members in by.items():
        quota = max(round(whole * weight.get(s, 0)), total[s] if budget is None else 0) if total[s] else 0
        epochs, left = divmod(quota, total[s]) if total[s] else (1, 0)
        block = lambda k: k % 8
        at = lambda e: sorted(((chained((17, 4), (e, 4), (block(k), 8)), block(k), chained((17, 4), (e, 4), (block(k), 8), (k, 8)), k), d, n) for d, n, k in members)  # noqa: E731, B023
        for e in range(epochs):
            for place, d, n in at(e):
                want[d, s, n, e, place[1], place[0], place[2]] += 1
        last, drawn = None, 0
        for place, d, n in at(epochs):
            if n and (drawn < left or place == last):
                want[d, s, n, epochs, place[1], place[0], place[2]] += 1
                last = place
            drawn += n
    mine = Counter((r["doc_id"], r["source"], r["n_tokens"], r["epoch"], r["block"], r["block_key"], r["order_key"]) for r in got)
    off = sum(((mine - want) + (want - mine)).values())
    assert off <= len(by) and mine, off  # weights are rounded to nine places, so a cut may fall one document off


def test_mixing(spark, awkward, empty):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else f"s{i % 3}") for i in range(2000)] + [(5000, None, "none"), (5001, "", None)]
    src = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = table(mixing.mix(src, max_repetition=3.0, blocks=8))
    tokens, drawn, least = Counter(), Counter(), Counter((r["doc_id"] for r in got))
    for i, t, s in rows:
        tokens[s] += len((t or "").split())
        assert 1 <= least[i] <= 4
    for r in got:
        drawn[r["source"]] += r["n_tokens"]
    share = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}
    ratio = {s: drawn[s] / tokens[s] for s in share}
    assert min(ratio.values()) == pytest.approx(1, abs=0.01) and max(ratio.values()) == pytest.approx(3, abs=0.1)
    even = table(mixing.mix(src, max_repetition=None, target_entropy=0.95, budget=4000))
    w = {r["source"]: r["weight"] for r in even if r["weight"] > 0}
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.95 * math.log(len(share)), abs=0.01)
    assert sum(r["n_tokens"] for r in even) == pytest.approx(4000, abs=30)
    for limit in (mixing.BROADCAST_ROWS, 0):
        docs = mixing.mixed_documents(src, max_repetition=3.0, blocks=8, broadcast_rows=limit)
        assert Counter(r.doc_id for r in docs.collect()) == least
    places = {}
    for r in got:
        places[r["doc_id"], r["epoch"]] = (r["epoch"], r["block_key"], r["order_key"])
    for part in mixing.mixed_documents(src.repartition(3), max_repetition=3.0, blocks=8).rdd.glom().collect():
        seen, order = Counter(), []
        for r in part:
            order.append(places[r.doc_id, seen[r.doc_id]])
            seen[r.doc_id] += 1
        assert order == sorted(order)  # each file is in the order of the permutation
    assert mixing.mix(empty).count() == mixing.mixed_documents(empty).count() == 0 and Counter(r["doc_id"] for r in table(mixing.mix(awkward, 1.0))) == Counter(i for i, *_ in AWKWARD)
    assert mixing.mixed_documents(awkward).columns == awkward.columns and {r.doc_id for r in mixing.mixed_documents(awkward).collect()} == {i for i, *_ in AWKWARD}


# --- chat


def brute_chat(rows):
    by, out = defaultdict(list), {}
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark, small):
    odd = [(1, 0, "system", "be <s> [brief] | \\ \\< <\\"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s><|assistant|>"), (1, 3, "user", None), (1, None, None, "x\ny"), (2, 0, "assistant", ""), (None, 0, "tool|>", "\U0001f600é"), (3, 1, "user", "tie"), (3, 1, "user", "tie")]
    odd += [(4, k, ("system", "user", "assistant")[0 if k == 0 else 1 + k % 2], f"turn {k} " * (k * 7 % 50)) for k in range(120)]
    src = spark.createDataFrame([(*r, "c") for r in odd], "conv_id long, turn long, role string, text string, window string")
    real = spark.read.parquet(f"{small}/conversations.parquet")
    for df in (src, real, src.limit(0)):
        got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(chat.format_windows(df)).collect()}
        assert got == brute_chat([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    for segment in (chat.SEGMENT, 700):
        windows = sorted((r for r in chat.format_windows(src, 200, 60, segment).collect() if r.conv_id == 4), key=lambda r: r.window)
        assert len(windows) > 10 and all(w.formatted.startswith("<s><|system|>") for w in windows) and any(w.n_repeated > 1 for w in windows)
        assert all(w.formatted.count("</s>") == w.formatted.count("<|") for w in windows)
        assert "".join(t.text for r in chat.format_windows(src, 200, 60, segment).where("conv_id = 4").orderBy("window").select(F.slice(chat.parse_window(F.col("formatted")), F.col("n_repeated") + 1, F.lit(999)).alias("t")).collect() for t in r.t) == "".join(t for c, k, _, t in odd if c == 4)


def test_windows_keep_their_budget(spark, small):
    """By a count of their own characters: none is over but by one turn and the system turn, and those that others follow are full."""
    long = [(7, 0, "system", "s" * 900), (7, 1, "user", "u" * 5000), (7, 2, "assistant", "a" * 300), (7, 3, "user", "b"), (8, 0, "system", "t" * 4000), (8, 1, "user", "x"), (8, 2, "assistant", "y<|")]
    rng = np.random.default_rng(6)
    long += [(9, k, ("user", "assistant")[k % 2], "z" * int(rng.integers(1, 250))) for k in range(3000)]
    real = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    src = real.unionByName(spark.createDataFrame(long, real.schema))
    fills = []
    by = defaultdict(list)
    for w in chat.format_windows(src).collect():
        by[w.conv_id].append(w)
    for windows in by.values():
        windows.sort(key=lambda w: w.window)
        for k, w in enumerate(windows):
            turns = re.findall(r"(?s)<\|.*?</s>", w.formatted)
            tokens = [-(-len(x) // 4) for x in turns]
            assert 1 + sum(tokens) == w.n_tokens and len(w.formatted) == 3 + sum(map(len, turns))
            system = turns[0].startswith("<|system") if w.n_repeated else False
            assert w.n_tokens <= 512 or len(turns) == 1 + system, (w.conv_id, w.window, tokens)
            assert sum(tokens[system : w.n_repeated]) <= 128
            if k + 1 < len(windows):
                fills.append(min(1, w.n_tokens / 512))
    assert len(fills) > 50 and sum(fills) / len(fills) > 0.8


@given(st.text(alphabet="<>[]|\\/sé x", max_size=30))
@settings(max_examples=200, deadline=None)
def test_escapes_are_reversible(text):
    escaped = re.sub(r"([<\[|\\])", r"\1\\", text)
    assert re.sub(r"([<\[|\\])\\", r"\1", escaped) == text and not re.search(r"</s>|<s>|<\||\[/?INST", escaped)


# --- suffix order


@given(st.lists(st.integers(97, 100), min_size=1, max_size=80), st.sampled_from([1, 7, 8, 9, 20]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_induced_sorting(tmp_path_factory, symbols, depth, spill):
    text = np.array([255 if s == 100 else s for s in symbols] + [255], np.uint8)
    at, shared = induced.suffix_order(text, depth, f"file://{tmp_path_factory.getbasetemp()}/q", memory=30 if spill else 1 << 28)
    raw = text.tobytes()
    cut = [raw[i : i + depth].ljust(depth, b"\0") for i in at.tolist()]
    assert sorted(at.tolist()) == list(range(len(raw))) and cut == sorted(cut)
    for a, b, n in zip(at.tolist(), at.tolist()[1:], shared.tolist()[1:], strict=False):
        if max(a, b) + depth <= len(raw):
            x, y = raw[a : a + depth], raw[b : b + depth]
            assert n == next((k for k in range(depth) if x[k] != y[k]), depth)


def brute_removed(rows, window=50):
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - window + 1 if d is not None else 0):
            g = raw[i : i + window]
            least[g] = min(least.get(g, d), d)
    out = Counter()
    for d, t in rows:
        raw, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(raw) - window + 1 if d is not None else 0):
            if least[raw[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("which", ["docs", "awkward", "empty"])
def test_suffix_dedup(request, which, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", 40_000)
    src = request.getfixturevalue(which)
    got = Counter(tuple(r)[:5] for r in suffix.removed_spans(src).collect())
    assert got == brute_removed([(r.doc_id, r.text) for r in src.collect()])


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup_of_repetitive_texts(spark, monkeypatch, hot):
    """Also with keys that count as hot, small shards, and shards worked off in parts."""
    if hot == 2:
        for name, value in (("BATCH_BYTES", 3000), ("SHARD_BYTES", 1000), ("MANY_SHARDS", 25)):
            monkeypatch.setattr(suffix, name, value)
    rng = np.random.default_rng(5)
    words = ["ab", "abab", "----------", "é", " ", "the passage that many share, word for word, and then some more of it"]
    rows = [(int(i), "".join(rng.choice(words, rng.integers(0, 40)))) for i in rng.permutation(150)]
    got = Counter(tuple(r)[:5] for r in suffix.removed_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot_batches=hot, memory=3000 if hot == 2 else 1 << 26).collect())
    assert got == brute_removed(rows)


def test_suffix_dedup_compares_bytes(spark):
    """Strings that agree in any polynomial modulo 2^64 stay two: what no smaller document holds is not removed."""
    rng = np.random.default_rng(0)
    y = rng.integers(98, 122, 1024)
    sign = np.array([1 - 2 * x for x in thue_morse(1024)])
    while True:
        gram = bytes(rng.integers(65, 91, 16).astype(np.uint8))
        texts = [b"".join(gram + bytes([c]) for c in letters) for letters in (y, y + sign)]
        row = {"data": zstandard.compress(b"".join(texts)), "offsets": [0, len(texts[0]), 2 * len(texts[0])], "ids": [1, 2]}
        batch = suffix._Batch(row, 50)
        if len(batch.start) == 2:
            break
    code = batch.hashes(batch.start, batch.size + 49)
    assert code[0] == code[1]  # they do collide
    rows = [(i + 1, t.decode()) for i, t in enumerate(texts)]
    for parts in (1, 2):
        got = Counter(tuple(r)[:5] for r in suffix.removed_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())
        assert got == brute_removed(rows)
    with pytest.raises(TypeError):
        suffix.removed_spans(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# --- top-k


def brute_top(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    asks = {}
    for i, v in ok:
        if i % 50 == 0:
            asks[i] = min(asks.get(i, v), v)
    for q, v in asks.items():
        scored = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), j) for j, c in ok if j != q and len(c) == len(v))[:k]
        for r, (s, j) in enumerate(scored, 1):
            out[q, r, j, -s] += 1
    return out


def test_top_k(spark, small):
    real = spark.read.parquet(f"{small}/embeddings.parquet")
    rng = np.random.default_rng(1)
    odd = [(int(i), (rng.normal(size=8) * rng.choice([0.01, 1, 30])).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    odd += [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [0.0] * 8), (2250, [1.0, 2.0]), (2251, [3.0, 4.0]), (2300, []), (None, [1.0] * 8), (50, [5.0] * 8), (7, [9.0] * 8), (7, [9.0] * 8)]
    src = spark.createDataFrame([(i, v, 1) for i, v in odd], "vec_id long, embedding array<double>, block int")
    for df, rows in [(real, 2048), (src, 64), (src.limit(0), 64)]:
        got = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, rows=rows).collect())
        assert got == brute_top([(r.vec_id, r.embedding) for r in df.collect()])


def test_blocks_are_pruned_before_vectors_move(spark):
    """Of clustered vectors most pairs of blocks can't hold a hit, and are left out by their summaries alone; the result is whole."""
    rng = np.random.default_rng(8)
    centres = np.eye(16) * 20
    rows = [(int(i), (centres[i % 16] * (1 + i % 3) + rng.normal(size=16)).tolist()) for i in range(6000)]
    src = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    valid = src.select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    index, asked = topk.pack(valid, 64), topk.pack(valid.where("vec_id % 5 = 0"), 16)
    armed = topk.arm(asked, topk.first_scores(asked, index, 5, 4))
    pairs, every = topk.admitted(armed, index, 4).agg(F.sum(F.size("blocks"))).first()[0], index.count() * asked.count()
    assert 0 < pairs < 0.3 * every
    got = Counter(tuple(r) for r in topk.top_k(src, F.col("vec_id") % 50 == 0, rows=64).collect())
    assert got == brute_top(rows)


def test_top_k_of_large_components(spark):
    rows = [(i, [1e12 * (i + 1), -3e11]) for i in range(3)] + [(50, [1.0, 1.0])]
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    want = Counter({(q, r, j, min(max(s, -(2**63)), 2**63 - 1)): n for (q, r, j, s), n in brute_top(rows).items()})
    assert sum((got & want).values()) >= len(want) - 2  # scores beyond 64 bits tie at the end of the range


# --- language


def ppm_bits(text, training, order, least=2):
    """Code length of bytes by counting, escaping and excluding as the method says, one byte after the other."""
    counts = defaultdict(Counter)
    for t in training:
        for i, c in enumerate(t):
            for k in range(min(i, order) + 1):
                counts[t[i - k : i]][c] += 1

    def probability(context, c):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        known = counts.get(context)
        if not known or len(context) >= 2 and sum(known.values()) < least:
            return probability(shorter, c)
        total, distinct = sum(known.values()), len(known)
        if c in known:
            return known[c] / (total + (distinct if distinct < 256 else 0))
        return distinct / (total + distinct) * probability(shorter, c) / (1 - sum(probability(shorter, x) for x in known))

    return -sum(math.log2(probability(text[max(0, i - order) : i], c)) for i, c in enumerate(text))


def test_code_lengths(spark):
    """The sparse trees' code lengths equal those of an independent model, in several languages, orders and sizes."""
    rng = np.random.default_rng(4)
    texts = {"a": [b"abracadabra banana", b"bandana cabana " * 3, b"x"], "b": ["éàé ça va là".encode(), "ß日本語 日本".encode() * 2, b""], "c": [bytes(rng.integers(97, 103, 60).astype(np.uint8)) for _ in range(4)]}
    for order in (0, 2, 5):
        rows = [(lang, t.decode()) for lang, x in texts.items() for t in x]
        counted = defaultdict(dict)
        for r in langid.count_grams(spark.createDataFrame(rows, "lang string, text string"), order).collect():
            counted[r.lang][r.gram & (1 << 64) - 1] = r.n
        trees = [langid.Tree.load(langid.Tree.fit(np.array(list(counted[x]), np.uint64), np.array(list(counted[x].values())), order).dump()) for x in texts]
        probes = [b"banana", b"", "éça 日本".encode(), bytes(rng.integers(0, 256, 40).astype(np.uint8)), b"abcabcfffabc", texts["c"][0]]
        bits = langid.code_lengths(np.frombuffer(b"".join(probes), np.uint8), np.cumsum([0, *map(len, probes)]), trees, order)
        for i, probe in enumerate(probes):
            for j, training in enumerate(texts.values()):
                assert bits[i, j] == pytest.approx(ppm_bits(probe, training, order), rel=1e-6, abs=1e-6), (order, probe, j)


def test_language(spark, small, awkward, empty):
    rows = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(rows).collect()}
    right = total = 0
    for r in rows.collect():
        mine = got[r.doc_id]
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= mine.score <= 1
        if mine.held_out:
            total, right = total + 1, right + (mine.lang_pred == r.lang)
    assert total > 100 and right / total > 0.97
    again = {r.doc_id: r for r in langid.identify(rows, model_bytes=1).collect()}  # a block for each language
    assert all(again[i].lang_pred == r.lang_pred and again[i].score == pytest.approx(r.score, abs=1e-9) for i, r in got.items())
    odd = Counter((r.doc_id, r.lang_pred == "und") for r in langid.identify(awkward).collect())
    assert odd == Counter((i, not any(c.isalpha() for c in t or "")) for i, t, *_ in AWKWARD)
    assert langid.identify(empty).count() == 0
    nothing = langid.identify(rows.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_rejected_by_language(spark, small, awkward, empty):
    """What no learned language codes shorter than its bytes goes, judged by the independent model; a missing language is filled in."""
    rows = [(i, " ".join(["the cat sat on the mat", "and it was the end of that"][:: 1 if i % 2 else -1]), "en") for i in range(40)] + [(i, "le chat est sur le lit et voici la fin", "fr") for i in range(40, 80)]
    odd = [(100, "the cat sat on the mat", None), (101, "le chat est sur le lit", None), (102, "Ωμέγα кошка 日本語 猫", None), (103, "qqqqzzzzxxxxkkkkjjjj", None), (104, "12 34", None), (105, None, "en"), (106, "the 日", None)]
    src = spark.createDataFrame([(*r, "own", 5) for r in rows + odd], "doc_id long, text string, lang string, Pred string, bits int")
    kept = {r.doc_id: r for r in langid.keep_identified(src).collect()}
    training = {lang: [t.encode() for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 3 != 1] for lang in ("en", "fr")}
    for i, t, lang in rows + odd:
        bits = {x: ppm_bits((t or "").encode(), training[x], 5) for x in training}
        stays = any(c.isalpha() for c in t or "") and min(bits.values()) < 8 * len(t.encode())
        assert (i in kept) == stays, (i, bits)
        assert not stays or (kept[i].lang == (lang or min(bits, key=bits.get)) and kept[i].Pred == "own" and kept[i].bits == 5)
    assert {100, 101} <= set(kept) and 102 not in kept
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert langid.keep_identified(docs).count() == docs.count() and langid.keep_identified(docs).columns == docs.columns  # clean documents stay
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == sum(any(c.isalpha() for c in t or "") for _, t, *_ in AWKWARD)
    assert langid.keep_identified(empty).count() == 0 and langid.keep_identified(awkward).columns == awkward.columns
    with pytest.raises(ValueError, match="blocks"):
        langid.keep_identified(src, model_bytes=1)


# --- the queries


def test_shared_folder(spark):
    kept = common.written(spark.range(3), "probe")
    assert kept.count() == 3 and common.shared_dir(spark).startswith("file:") and common.clear(spark) > 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text)]
    groups = brute_groups(rows, 5, 80)
    kept = {k[0] for k in groups if k[3]}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept -= {k[0] for k in brute_hits(rows, bench) if k[5]}
    out = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in out} == kept and {r.shard for r in out} <= set(range(8))
    # Copies are those that the mix of what is left draws, which has a test of its own.
    left = docs.where(F.col("doc_id").isin(sorted(kept)))
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixing.mix(left).collect()) and len(out) > len(kept)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += len(r.text.encode()) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(len(r.text.encode()) for r in out)
