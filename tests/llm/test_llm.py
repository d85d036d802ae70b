import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessaryn.llm import content, copies, mixing, names, survivors, tokens

HAVE = os.path.exists(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE}")


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("a", "America/New_York", "mdy", 2), ("b", "Europe/London", "dmy", 1)], "source_system string, default_zone string, day_order string, trust_rank int")


def test_name_rules():
    w = names.words
    assert w("Rosgate, O.") == ["o", "rosgate"] and w("Sean O'Brien") == w("O Brien, Sean") == ["sean", "obrien"] and w("Mary Ann Smith") == ["mary", "ann", "smith"]
    assert w("Müller-Lüd, Dr. Jürgen P.") == ["jurgen", "p", "muller", "lud"] and w("Gantry & The Oxtarn Dairy Ltd") == ["gantry", "oxtarn", "dairy"] and w("de la Cruz Jr.")[-1] == names.YOUNGER
    assert names.name_match(w("Theo Ballard"), w("Ballard, Theodore")) == 2 and names.name_match(w("S. Delhart"), w("Samuel Dehlart")) == 1
    assert names.name_match(w("Frances Samantha Wes"), w("Johannes Joseph Wes")) == 0 and names.name_match([], w("x y")) == 0
    assert names.date_match(["1990-03-04"], ["1990-04-03"]) == 2 and names.date_match(["1957-01-13"], ["1984-01-13"]) == -1 and names.date_match([], ["1984-01-13"]) == 0
    assert names.distance("abcd", "abdc", 2) == 1 and names.distance("", "abc", 2) == 3 and len(k := names._keys(["ted von ballard", "t ballard"], ["1990-03-04"], ["1", "2"])) == len(set(k))


def test_distance_against_the_whole_table():
    def whole(a, b):
        t = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
        return t[-1][-1]

    rnd = random.Random(2)
    for _ in range(5000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(8))) for _ in "xy")
        for most in (1, 2, 3):
            assert names.distance(a, b, most) == min(whole(a, b), most + 1), (a, b)


def test_linked_pairs(spark, sources):
    rows = [
        (0, "x1", "Theodore Ballard", "1990-03-04", "11111"), (1, "x2", "Ballard, Theo", "03/04/1990", "11111"), (2, "x3", "T. Ballard", "1990-03-04", "99999"), (3, "x4", "theodore  BALLARD", "1990-03-04", "11111"),
        (4, "x5", "Theodore Ballard", "1963-03-04", "11111"), (5, "x6", "Ann Ballard", "1990-03-04", "11111"), (6, "x7", "n/a", "1990-03-04", "11111"), (7, None, None, None, None),
        (8, "x8", "Theodore Ballard", None, "11111"), (9, "y1", "Mia Kroll", "1980-01-01", None), (10, "Y-1", "Mia Krol", None, "5"), (11, "z", "q" * 3000, None, None),
    ]
    df = spark.createDataFrame([(*r, "a", "clash") for r in rows], "id bigint, app string, n string, d string, z string, s string, spelling string")
    pairs = names.variant_pairs(names.linked(df, sources, "id", "n", "d", "z", "app", "s"))
    assert sorted(tuple(r) for r in pairs.collect()) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (9, 10)]
    assert names.linked(df.limit(0), sources, "id", "n", "d", "z", "app", "s").count() == 0


def joined(pairs):
    """The groups that pairs link."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups: dict = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


ENTITY = "entity bigint, names array<string>, dates array<string>, zips array<string>"


def test_hot_block_is_split(spark):
    rows = [(i, [f"{g} {s}"], ["1970-01-01"], ["11111"]) for i, (g, s) in enumerate((f"gi{chr(97 + a)}{chr(97 + b)}n", f"su{chr(97 + b)}{chr(97 + a)}m") for a in range(18) for b in range(18))]
    rows.append((9999, [rows[5][1][0]], ["1970-01-01"], ["11111"]))
    e = spark.createDataFrame(rows, ENTITY)
    got = {(r.a, r.b) for r in names.matches(names.keys_of(e).withColumn("fresh", F.lit(True)), e).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and names.same(*a[1:], *b[1:])}
    assert (5, 9999) in got and got <= want and want - got <= {(a, b) for a, b in want if b == 9999}  # 5 stands for its equal


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 32), (7, 7)]
    got = {r.node: r.root for r in names.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 21)} == {1} and {got[i] for i in (30, 31, 32)} == {30}


def test_copies_against_brute_force_and_ledger(spark):
    rnd = random.Random(1)
    base = [(f"app{i % 7}", f"Mail{i % 5}@x.org", None if i % 3 else "", f"a=1; b={i % 4}") for i in range(60)]
    rows = [(i, a.upper() if rnd.random() < 0.5 else a + " ", f"<{m}>", g, "; ".join(reversed(n.split("; "))) if rnd.random() < 0.5 else n) for i, (a, m, g, n) in enumerate(base)]
    df = spark.createDataFrame(rows, "row bigint, application_id string, raw_e string, raw_g string, raw_notes string").withColumn("key", F.lit("clash"))
    fields, entries = ["application_id", "raw_e", "raw_g", "raw_notes"], {"raw_notes": ";"}
    groups = {}
    for i, b in enumerate(base):
        groups.setdefault(b, []).append(i)
    want = sorted((g[0], x) for g in groups.values() for x in g[1:])
    assert sorted(tuple(r) for r in copies.surplus_copies(df, "row", fields, entries).collect()) == want
    assert sorted(r.copies for r in copies.collapsed(df, "row", fields, entries).collect()) == sorted(map(len, groups.values()))
    assert copies.surplus_copies(df.limit(0), "row", fields, entries).count() == 0


def test_ledger_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    batch = lambda rows: spark.createDataFrame([(bytes([k]) * 16, i) for k, i in rows], "key binary, row_id bigint")
    copies.CopyLedger(spark, path, bucket_rows=4).add(batch([(1, 5), (1, 3), (2, 9)]))
    again = copies.CopyLedger(spark, path, bucket_rows=4)
    assert again.version == 1 and sorted((r.key[0], r.n, r.first_id) for r in again.read().collect()) == [(1, 2, 3), (2, 1, 9)]
    again.add(batch([(2, 4)])).add(batch([(k, 100 + k) for k in range(3, 20)]))
    last = copies.CopyLedger(spark, path, bucket_rows=4)
    assert last.buckets == 8 and last.version == 3 and sum(last.rows.values()) == 19
    kept = dict(last.files)
    last.add(batch([(7, 1)]))
    assert sum(last.files[b] != f for b, f in kept.items()) == 1  # one key touches one bucket
    got = {r.key[0]: (r.n, r.first_id) for r in copies.CopyLedger(spark, path, bucket_rows=4).read().collect()}
    assert got == {1: (2, 3), 2: (2, 4), 7: (2, 1), **{k: (1, 100 + k) for k in range(3, 20) if k != 7}}
    with pytest.raises(FileExistsError):
        again.add(batch([(1, 1)]))  # another writer was faster
    assert copies.CopyLedger(spark, f"file://{tmp_path}/new").add(batch([])).read().count() == 0


def test_learned_order_on_hidden_instants(spark, sources):
    rows = []
    for g in range(400):  # 12 in front of abc in nine of ten groups, trust and row id say the reverse
        first, last = ("12", "abc") if g % 10 else ("abc", "12")
        rows += [(2 * g + 1, f"g{g}", "2024-01-01T00:00:00Z", "a", first), (2 * g, f"g{g}", "2024-01-02T00:00:00Z", "a", last)]
    df = spark.createDataFrame(rows, "row bigint, app string, t string, s string, f string")
    prep = survivors.written(survivors.prepared(df, sources, "app", "row", "t", "s", ["f"]), "t")
    r = survivors.evidence(prep, ["f"]).first()
    assert r.edges == 1 and r.n > 50 and r.decided > 0.8 * r.n and r.right > 0.8 * r.n > 0.2 * r.n > r.right_without


def test_survivors(spark, sources):
    rows = [
        (1, "A-1", "2024-01-02T00:00:00Z", "b", "old", None), (2, "a1", "2024-01-03T00:00:00Z", "a", "new", "N/A"), (3, "a 1", None, "b", "undated", "x"), (4, "a1", None, "a", "u", "y"), (5, "b", None, None, "only", "one"),
        (6, "c", None, None, "p", "?"), (7, "c", None, None, "q", " "), (8, None, None, "a", "n", "n"), (9, None, None, "a", "n", "n"),
    ]
    df = spark.createDataFrame(rows, "row bigint, app string, t string, s string, f string, g string")
    prep = survivors.prepared(df, sources, "app", "row", "t", "s", ["f", "g"])
    assert sorted(tuple(r) for r in survivors.surviving_rows(prep, ["f", "g"]).collect()) == [(1, "f", 2), (1, "g", 3), (6, "f", 7)]
    edges = spark.createDataFrame([("f", "a", "9")], "field_name string, state string, next_state string")
    late = spark.createDataFrame([(1, "z", None, None, "7", "v"), (2, "z", None, None, "w", "v")], df.schema)
    got = survivors.surviving_rows(survivors.prepared(late, sources, "app", "row", "t", "s", ["f", "g"]), ["f", "g"], edges).collect()
    assert sorted(tuple(r) for r in got) == [(1, "f", 1), (1, "g", 2)]
    moves = [(100 * i + j, f"g{i}", f"2024-01-0{j + 1}T00:00:00Z", "a", "abc" if j == 0 else "12", "k") for i in range(30) for j in range(2)]
    learned = survivors.learned_edges(survivors.written(survivors.prepared(spark.createDataFrame(moves, df.schema), sources, "app", "row", "t", "s", ["f", "g"]), "t"), ["f", "g"])
    assert [tuple(r) for r in learned.collect()] == [("f", "a", "9")]


@pytest.mark.skipif(not HAVE, reason="no tokenizer files here")
def test_tokens(spark):
    texts = ["Hello  world\n\n it's 2024 <|endoftext|>", "", None, " ", "日本語 テキスト　x y", "a" * 5000, "don't 'LL \x1c\t z", "Hello  world\n\n it's 2024 <|endoftext|>", "é 👩‍👩‍👧 ١٢٣"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, "again", "c")], "doc_id bigint, text string, word string")
    enc = tokens._encoder(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE}")
    want = sorted([(i, enc.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)] + [(0, enc.encode("again").ids)])
    ids = tokens.encoded(df)
    assert sorted((r.doc_id, list(r.ids)) for r in ids.collect()) == want
    back = {r.doc_id: r.text for r in tokens.decoded(ids.where("doc_id > 0")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if i)
    assert tokens.encoded(df.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in tokens.token_counts(df.where("doc_id > 0")).collect()} == {i: len(x) for i, x in want if i}


def test_pfair_keeps_within_a_block():
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    order = mixing.pfair(w, {k: round(v * 1000) for k, v in w.items()}, 1000)
    done = dict.fromkeys(w, 0)
    for t, (s, k, slot) in enumerate(order, 1):
        assert slot == t - 1 and k == done[s]
        done[s] += 1
        assert all(abs(done[x] - w[x] * t) < 1 for x in w)
    assert len(order) == 1000


def test_mixing(spark):
    sizes = spark.createDataFrame([(i, "big" if i < 90 else "small", 10) for i in range(100)] + [(200, None, 10), (201, "big", 0)], "doc_id bigint, source string, tokens bigint")
    mix = spark.createDataFrame([("m", 600, "big", 0.5, 1), ("m", 600, "small", 0.5, 3), ("n", 400, "small", 1.0, 3), ("n", 400, "none", 1.0, 3), ("o", 0, "big", 1.0, 1)], "mix_name string, total_tokens bigint, source string, target_weight double, max_repeats int")
    assert sorted(tuple(r) for r in mixing.short_sources(mix, sizes).collect()) == [("n", "none")]
    assert all(r.most < 1 for r in mixing.deviations(mix, sizes).collect() if r.source != "none")
    drawn = mixing.mixed(mix, sizes)
    assert {(r.mix_name, r.source): (r.tokens, r.repeats) for r in mixing.shares(mix, sizes).collect()} == {("m", "big"): (300, 1), ("m", "small"): (300, 3), ("n", "small"): (200, 2), ("n", "none"): (0, 0), ("o", "big"): (0, 0)}
    assert drawn.groupBy("mix_name", "source", "doc_id", "repeat").count().where("count > 1").count() == 0 and drawn.where("slot IS NULL").count() == 0


def test_set_apart_letters_join_their_own_word_only():
    insult = lambda t: content.votes(content.plain(t), 0, 0)[0]
    assert content.plain("du Volli d i o t!") == "du volli _diot" and insult("du Volli d i o t!") == insult("b a s t a r d") == insult("you b1tch") == 1
    assert insult("Please push it head on over to the desk") == insult("a b c") == 0


def test_content(spark):
    fine = ["Thank you for the loan.", "My savings stood at 12,000.", "Vermin damage is not covered by the home insurance.", "Kill the old direct debit, please.", "The dog, a bitch of four years, needs surgery.", "Staff may end a call when the caller is abusive."]
    bad = ["You are an idiot, all of you.", "Go\nto\nhell,\nyou\nmoron.", "You ... are ... a ... b1tch, ... all ... of ... you.", "Drop dead, nobody would miss you.", "Immigrants are rats, don't lend them a cent.", "Halt die Fresse, du Volli d i o t.", "Eres un id1ota y un hijo de puta.", "F u c k off, you scуmbag."]
    texts = [(i, f"{fine[i % len(fine)]} Ref {i}.", "s") for i in range(60)] + [(100 + i, f"{fine[i % 2]} {b}", None) for i, b in enumerate(bad)] + [(300, None, "s"), (301, "", "s"), (302, "x" * 50_000, "s")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(100, 1, "r"), (100, 0, "q"), (1, 0, "r"), (2, None, "r")], "doc_id bigint, flagged int, reviewer string")
    scores = content.scored(docs, labels)
    got = {r.doc_id: r.score for r in scores.collect()}
    assert len(got) == len(texts) and got[300] == got[301] == 0
    assert [i for i in got if got[i] >= 0.5] and sum(got[100 + i] >= 0.5 for i in range(len(bad))) >= len(bad) - 1
    assert not [i for i in range(60) if got[i] >= 0.5]
    assert {r.source: r.documents for r in content.rates(docs.drop("score"), scores).collect()} == {"s": 63, None: len(bad)}
    assert content.scored(docs.limit(0), labels).count() == 0


def test_hot_block_loses_no_agreeing_names(spark):
    rows = [(i, [f"gi{chr(97 + a)}{chr(97 + b)}n su{chr(97 + b)}{chr(97 + a)}m"], ["1970-01-01"], ["11111"]) for i, (a, b) in enumerate((a, b) for a in range(18) for b in range(18))]
    odd = ["john smith", "j smith", "smith", "jovn snith", "theodore ballard", "theo balard", "ann vandenberg", "annvan denberg", "bo li", "li bo"]
    rows += [(1000 + i, [n], ["1970-01-01"], ["11111"]) for i, n in enumerate(odd)] + [(2000 + i, ["john smith"], ["1970-01-01"], ["11111"]) for i in range(3)]
    rows += [(3000 + i, [n], [], [z]) for i, (n, z) in enumerate([("john smith", "11111"), ("j smith", "11112"), ("bo li", "11111")])] + [(4000, ["john smith"], ["1971-01-01"], ["11112"])]
    e = spark.createDataFrame(rows, ENTITY)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and names.same(*a[1:], *b[1:])}
    for chunk in (names.CHUNK, 100):
        names.CHUNK, before = chunk, names.CHUNK
        got = {(r.a, r.b) for r in names.matches(e.select(F.lit(1).cast("bigint").alias("key"), "entity", F.lit(True).alias("fresh")), e).collect()}
        names.CHUNK = before
        assert got <= want and joined(got) == joined(want)
        same = {1000, 2000, 2001, 2002}  # equal ones are linked to the first, which stands for all
        assert {p for p in want if not same & set(p)} <= got and {p for p in want if 1000 in p} <= got


def test_name_keys_cover_name_match():
    rnd, pool = random.Random(3), ["theodore", "ballard", "john", "smith", "bo", "li", "vandenberg", "christopher", "ann", "kit", "barney", "o"]
    seen = []
    for _ in range(400):
        n = rnd.sample(pool, rnd.choice([1, 2, 2, 3]))
        for _ in range(rnd.randrange(5)):
            k = rnd.randrange(len(n))
            w, at = n[k], rnd.randrange(len(n[k]))
            n[k] = rnd.choice([w[:at] + "x" + w[at:], w[:at] + w[at + 1 :], w[:at] + "q" + w[at + 1 :], w[:at] + w[at + 1 : at + 2] + w[at : at + 1] + w[at + 2 :], w[:1]]) or w
        seen.append((n, names._name_keys(n)))
    assert [(a, b) for a, ka in seen for b, kb in seen if names.name_match(a, b) and not ka & kb] == []


def test_slipped_dates_and_zips_share_a_key(spark, sources):
    rnd = random.Random(5)
    dates = ["1973-01-24", "1973-01-25", "1973-02-01", "1972-12-30", "1973-01-02", "1983-01-24", "1973-03-24", "1974-01-24", "1963-11-24", "1990-03-04", "1990-04-03"]
    dates += [f"{rnd.randrange(1970, 1974)}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 29):02}" for _ in range(150)]
    assert [(a, b) for a in dates for b in dates if names.date_match([a], [b]) == 1 and not names._parts(a) & names._parts(b)] == []
    zips = ["80396", "80369", "80397", "08396", "80390", None]
    facts = [([n], d, z) for n in ("ravelin wexmoor", "wexmoor raveling", "r wexmoor", "ted wexmoor ravelin", "theodore wexmor") for d in [*dates[:11], None] for z in zips] + [(["bo li"], "1973-01-24", z) for z in zips]
    own = [(x, set(names._keys(*x))) for x in (([*n], [d] if d else [], [z] if z else []) for n, d, z in facts)]
    assert [(x, y) for x, k in own for y, l in own if names.same(*x, *y) and not k & l] == []
    assert sum(names.same(*x, *y) > 0 for x, _ in own for y, _ in own) > 10_000
    rows = [(0, "a1", "Ravelin & Wexmoor Electrical", "1973-01-24", None), (1, "a2", "Wexmoor & Ravelin Electrical", "1973-01-25", "80396"), (2, "b1", "Ann Gatwick", "1980-05-05", "10001"), (3, "b2", "Gatwick, Ann", "1980-05-06", "10002"), (4, "c1", "Bo Li", "1960-01-01", "20001"), (5, "c2", "Li, Bo", "1960-01-01", "39999")]
    df = spark.createDataFrame([(*r, "b") for r in rows], "id bigint, app string, n string, d string, z string, s string")
    assert sorted(tuple(r) for r in names.variant_pairs(names.linked(df, sources, "id", "n", "d", "z", "app", "s")).collect()) == [(0, 1), (2, 3), (4, 5)]


def test_merging_goes_on_until_nothing_merges(spark):
    own = ["theodore ballard", "mikhail vostrikov", "agnes pemberwick", "yusuf kandoro", "bridget lonnegan", "fabrice duchamp", "wanjiru oketch", "sigrid halvorsen", "paolo zamboni", "hazel quimby", "ruben castellon"]
    other = ["cuthbert inglemoss", "nadia prokhorov", "ezekiel tumbler", "gwyneth brackley", "osvald jurgens", "lucrezia fontane", "duncan mcswain", "xiomara velez", "ignatz hofbauer"]
    day = lambda i: f"{1900 + 3 * i}-{1 + i % 12:02}-{1 + (5 * i) % 28:02}"
    rows = []
    for k in range(9):
        rows += [(f"g{k}", own[k], day(k), None), (f"g{k}", own[k + 1], day(20 + k), None), (f"g{k}", other[k], day(k + 2), None)] + ([("g0", own[0], day(1), None)] if k == 0 else [])
    rows += [("u", "john smith", None, "11111"), ("u", "maria jones", None, "22222"), ("d1", "john smith", "1990-12-31", "11111"), ("d2", "maria jones", "1990-12-31", "33333")]
    prof = spark.createDataFrame([(i, n, d, z, g) for i, (g, n, d, z) in enumerate(rows)], "row_id bigint, name string, date string, zip string, group_key string")
    found = {r.group_key: r.entity for r in names.resolve(prof).collect()}
    got = {i: found[r[0]] for i, r in enumerate(rows)}
    assert {got[i] for i in range(len(rows) - 4)} == {0} and len({got[i] for i in range(len(rows) - 4, len(rows))}) == 1
    with pytest.raises(RuntimeError, match="still merge"):
        names.resolve(prof, 1)


def test_sketches_keep_what_matches_and_little_else():
    rnd = random.Random(11)
    given, family = ["samuel", "sam", "theodore", "ted", "frankie", "frances", "phillip", "ann", "kit", "christopher", "o"], ["ballard", "barney", "holonford", "vandenberg", "wexmoor", "li", "delhart", "ostrick", "frankieson"]
    entities = []
    for i in range(1200):
        n = [rnd.choice(given), *([rnd.choice(given)[:1]] if rnd.random() < 0.2 else []), *rnd.sample(family, rnd.choice([0, 1, 1, 1, 2])), *([names.YOUNGER] if rnd.random() < 0.05 else [])]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            k = rnd.randrange(len(n))
            w, at = n[k], rnd.randrange(len(n[k]))
            n[k] = rnd.choice([w[:at] + "x" + w[at:], w[:at] + w[at + 1 :], w[:at] + "q" + w[at + 1 :], w[:at] + w[at + 1 : at + 2] + w[at : at + 1] + w[at + 2 :], w[:1], w.replace("rn", "m")]) or w
        rnd.shuffle(n)
        if rnd.random() < 0.1:
            n = ["".join(n)]
        dates = rnd.sample(["1973-01-24", "1973-01-25", "1973-02-02", "1973-01-28", "1983-01-24", "1974-01-24", "1963-01-24", "1990-03-04", "1990-04-03"], rnd.choice([0, 1, 1, 1, 1, 1, 2]))
        entities.append((i, [" ".join(n)], dates, rnd.sample(["80396", "80369", "80397", "08396", "11111"], rnd.choice([0, 1, 1, 1, 2]))))
    sketched = [(1, e[0], *names._name_sketch(e[1][0]), names._day_sketch(e[2]), names._place_sketch(e[3]), True) for e in entities]
    block = pd.DataFrame(sketched, columns=["key", "entity", *names.SKETCH, "fresh"])
    want = {(a[0], b[0]) for a in entities for b in entities if a[0] < b[0] and names.same(*a[1:], *b[1:])}
    names.BLOCK_LIMIT, before = len(entities), names.BLOCK_LIMIT
    try:
        got = [p for d in names._paired(iter([block[:500], block[500:501], block[501:]])) for p in zip(d["a"], d["b"], d["big"], strict=True)]
        names.BLOCK_LIMIT = 700
        over = pd.concat(names._paired(iter([block[:500], block[500:900], block[900:], block.assign(key=2)[:2]])))
    finally:
        names.BLOCK_LIMIT = before
    assert len(want) > 5000 and want <= {(a, b) for a, b, _ in got} and not any(big for *_, big in got)
    assert [(r.a, r.b) for r in over.itertuples() if r.big] == [(1, 1200)]
    # one date, one given name, other family names: before, all 499 500 pairs of such a block were judged
    syllables = ["bal", "dor", "fen", "gim", "hux", "kov", "lun", "pry", "sten", "tam", "vor", "wick"]
    people = [(7, i, *names._name_sketch("samuel " + "".join(rnd.sample(syllables, 3))), names._day_sketch(["1973-01-24"]), names._place_sketch([f"{rnd.randrange(100000):05d}"]), True) for i in range(1000)]
    assert sum(len(d) for d in names._paired(iter([pd.DataFrame(people, columns=block.columns)]))) < 100_000
