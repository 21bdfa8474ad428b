import random
import re
from collections import defaultdict
from itertools import product

from loomgrid.llm.surrogates import _luhn, _mod97, entities, permute, replace, settled, surrogate, written

KEY = b"test key"


def test_permutation():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(permute(x, size, KEY, "t") for x in range(size)) == list(range(size))


def kinds(text):
    return [(k.split(":")[0], text[s:e]) for s, e, k, *_ in entities(text)]


def test_detection():
    assert kinds("mail a.b@mail8.example.com, ip 10.2.3.4. tel +1 (372) 555-7739 card 4111 1111 1111 1111") == [("email", "a.b@mail8.example.com"), ("ip", "10.2.3.4"), ("phone", "+1 (372) 555-7739"), ("card", "4111 1111 1111 1111")]
    assert kinds("ssn 123-45-6789 iban DE89370400440532013000 bad DE00370400440532013000") == [("ssn", "123-45-6789"), ("iban", "DE89370400440532013000")]
    assert kinds("Dr. Anna Novak met Frau Müller") == [("name", "Anna"), ("name", "Novak"), ("name", "Müller")]
    for calm in ("v1.2.3.4.5", "in 2024 about 3.5 of 100,000", "no names here", "Order 12345", "1.2.3", "a@b"):
        assert kinds(calm) == [], calm


def test_formats():
    for kind, value in (("card", "4111111111111111"), ("card", "9597024294303453"), ("phone", "+13725557739"), ("ssn", "123456789"), ("email", "john.doe9@mail8.example.com"), ("ip", "192.168.3.4"), ("ip", "56.245.126.157"), ("iban", "DE89370400440532013000")):
        new = surrogate(kind, value, KEY)
        assert new != value and len(re.sub(r"\d", "", new)) == len(re.sub(r"\d", "", value))
        if kind != "ip":
            assert re.sub("[a-z]", "a", re.sub(r"\d", "9", new)) == re.sub("[a-z]", "a", re.sub(r"\d", "9", value))
    card = surrogate("card", "4111111111111111", KEY)
    assert _luhn(card[:-1]) == int(card[-1]) and card[0] == "4"
    assert surrogate("phone", "+13725557739", KEY).startswith("+1")
    assert surrogate("ip", "192.168.3.4", KEY).startswith("192.168.")
    assert _mod97(surrogate("iban", "DE89370400440532013000", KEY)) == 1
    assert written("name:given:latin", "ANNA", "maria") == "MARIA"
    assert "а" <= surrogate("name:surname:cyrillic", "иванова", KEY)[0] <= "я"
    assert [surrogate("name:given:latin", "anna", KEY, 0, g)[-3:] for g in "f"] == ["ina"] and surrogate("name:given:latin", "paul", KEY, 0, "m").endswith("an")
    assert len({surrogate("card", f"4{k:015d}", KEY) for k in range(2000)}) == 2000


def test_replacement(spark):
    rng = random.Random(8)
    mails = [f"user{k}@mail{k % 9}.example.com" for k in range(40)]
    rows = [(i, f"one {rng.choice(mails)} and 56.245.{i % 200}.{i % 7} or +1 (372) 555-{i:04d} end") for i in range(300)]
    rows += [(None, "Dr. Anna Novak"), (900, None), (901, "clean text"), (1, rows[1][1])]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, entities string").repartition(3)
    got = replace(df, KEY).collect()
    assert len(got) == len(rows)
    before = {i: t for i, t in rows}
    both = defaultdict(set)
    for r in got:
        old = before[r.doc_id]
        assert (r.text is None) == (old is None)
        for e in r.entities:
            was, now = old[e.start : e.end], r.text[e.new_start : e.new_end]
            assert was != now
            both[e.kind, was].add(now)
        if not r.entities:
            assert r.text == old
    assert all(len(v) == 1 for v in both.values())
    new = [(k, n) for (k, _), v in both.items() if k != "name" for n in v]
    assert len(new) == len(set(new)) and not {n for _, n in new} & {w for _, w in both}


def narrow(kind, value, key, attempt=0, gender=""):  # many collisions
    return surrogate(kind, value, key, attempt)[:-9] + str(int(value.split("@")[0][4:]) % (3 + attempt * 50)) + "@x.com" if kind == "email" else surrogate(kind, value, key, attempt, gender)


def test_collisions_are_resolved(spark):
    rows = [(k, f"user{k}@m.com and again user{k}@m.com") for k in range(60)]
    for bound in (1_000, 0):
        got = replace(spark.createDataFrame(rows, "doc_id long, text string"), KEY, exceptions=bound, make=narrow).collect()
        words = [set(re.findall(r"\S+@\S+", r.text)) for r in got]
        assert all(len(w) == 1 for w in words) and len(set().union(*words)) == 60


def test_empty(spark):
    assert replace(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_phrases_at_sentence_start_and_in_any_case():
    for text, name in (("Je m'appelle Gaston Leroux.", "Gaston Leroux"), ("Me llamo Pablo Ruiz.", "Pablo Ruiz"), ("Меня зовут Ярослав Гашек.", "Ярослав Гашек"), ("MY NAME IS Gordon Brown", "Gordon Brown"), ("My name is Gordon Brown", "Gordon Brown"), ("Mein Name ist Gordon Braun", "Gordon Braun"), ("MEİN NAME ıST Gordon Braun", "Gordon Braun")):
        assert kinds(text) == [("name", w) for w in name.split()], text


def test_more_short_names_than_two_syllables_make(spark):
    names = ["".join(w) for w in product("bcdfghjklm", "aeiou", "npqrstvwxz", "aeiou", "bcdfghjklmnpqrstvwxz")]
    rows = [(f"name:{part}:latin", v, g) for part, g in (("given", "n"), ("surname", "")) for v in names]
    assert len(names) == 50_000
    got = settled(spark.createDataFrame(rows, "kind string, value string, gender string").repartition(4), KEY).collect()
    assert len(got) == len({(r.kind, r.value) for r in got}) == len(rows)
    assert len({r.new for r in got}) == len(rows) and not {r.new for r in got} & set(names)
    assert max(len(r.new) for r in got) <= 16


def test_full_formats_are_dealt_among_themselves(spark):
    rows = [("ip", f"192.168.{a}.{b}", "") for a in range(256) for b in range(256)]
    rows += [("email", f"{a}@{b}.com", "") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows += [("email", "ع@ع.com", "")]
    got = settled(spark.createDataFrame(rows, "kind string, value string, gender string").repartition(4), KEY).collect()
    assert len(got) == len(rows) == len({(r.kind, r.value) for r in got}) == len({(r.kind, r.new) for r in got})
    assert all(r.new != r.value for r in got)
    assert {r.new for r in got if r.kind == "ip"} == {v for k, v, _ in rows if k == "ip"}


def test_one_person_has_one_surrogate(spark):
    texts = [
        "Mr. Kim Lee met Dr. Kim Lee. Kim Lee left.", "John Smith came late. Smith won, and SMITH is glad.", "Dr. Kim Lee spoke.", "Dear Kim, thanks.\nBest regards,\nGwen Stacy", "write to ada.byron@x.org, who is Ada Byron",
    ]
    got = {r.doc_id: r for r in replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    words = lambda i: [(texts[i][e.start : e.end], got[i].text[e.new_start : e.new_end]) for e in got[i].entities]
    assert [w for w, _ in words(0)] == ["Kim", "Lee"] * 3 and len(set(words(0))) == 2
    assert [w for w, _ in words(1)] == ["John", "Smith", "Smith", "SMITH"]
    new = dict(words(1))
    assert new["SMITH"] == new["Smith"].upper()
    told = dict(words(0))
    assert told["Kim"].endswith("an") and dict(words(2)) == told and dict(words(3))["Kim"] == told["Kim"]
    assert [w for w, _ in words(3)] == ["Kim", "Gwen", "Stacy"]
    assert [w for w, _ in words(4)] == ["ada.byron@x.org", "Ada", "Byron"]
    for calm in ("Dear Customer, thanks.", "Hello World!", "The Red House. Name: none", "Anna", "From: the start"):
        assert kinds(calm) == [], calm


def brute(rows, make):
    """All of the query in one loop over plain values."""
    told, real = {}, set()
    for _, text in rows:
        for kind, value, gender in {x[2:] for x in entities(text or "")}:
            told.setdefault((kind, value), []).append(gender)
            real.add((kind.split(":")[0], value))
    gender = {k: "m" if g.count("m") > g.count("f") else "f" if g.count("f") > g.count("m") else max(g) and "n" for k, g in told.items()}
    new, used, todo, attempt = {}, set(), sorted(told, key=lambda k: (k[1], k[0])), 0
    while todo:
        drawn = {k: make(*k, KEY, attempt, gender[k]) for k in todo}
        before, left = set(used), []
        for k in todo:
            at = (k[0].split(":")[0], drawn[k])
            if at in real or at in before or at in used:
                left.append(k)
            else:
                new[k] = drawn[k]
                used.add(at)
        todo, attempt = left, attempt + 1
    out = []
    for i, text in rows:
        done, at = "", 0
        for s, e, kind, value, _ in entities(text or ""):
            done += text[at:s] + written(kind, text[s:e], new[kind, value])
            at = e
        out.append((i, text if text is None else done + text[at:]))
    return sorted(out, key=str)


def test_the_whole_query_is_brute_force(spark):
    rng = random.Random(31)
    name = lambda: rng.choice(("Anna", "Kim", "Paul", "Ivo", "Eva")) + " " + rng.choice(("Lee", "Novak", "Smith", "Braun"))
    parts = (lambda: f"user{rng.randrange(40)}@m{rng.randrange(3)}.com", lambda: f"192.168.{rng.randrange(2)}.{rng.randrange(9)}", lambda: f"{rng.choice(('Mr.', 'Ms.', 'Dr.', 'Frau'))} {name()}", name, lambda: f"+1 (372) 555-{rng.randrange(9999):04d}", lambda: f"4{rng.randrange(10**15):015d}", lambda: "some words. And")
    rows = [(i, " then ".join(rng.choice(parts)() for _ in range(rng.randrange(6)))) for i in range(200)] + [(None, "Kim Lee and Mr. Kim Lee"), (500, None), (3, "Mrs. Kim Lee")]
    for make in (surrogate, narrow):
        for bound in (1_000, 0):
            got = replace(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), KEY, exceptions=bound, make=make).collect()
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(rows, make)


SCRIPTS = {"arabic": 0x660, "persian": 0x6F0, "devanagari": 0x966, "full width": 0xFF10, "thai": 0xE50}


def in_script(text, zero):
    return "".join(chr(zero + int(c)) if c in "0123456789" else c for c in text)


def test_digits_of_every_script(spark):
    plain = ["Call 123-456-7890 now.", "card 4111 1111 1111 1111", "SSN 078-05-1120 it is", "at 192.168.4.20 there", "ring +49 30 1234567 please"]
    rows = [(k, t) for k, t in enumerate(plain)]
    rows += [(100 * n + k, in_script(t, zero)) for n, zero in enumerate(SCRIPTS.values(), 1) for k, t in enumerate(plain)]
    got = {r.doc_id: r for r in replace(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), b"k").collect()}
    assert len(got) == len(rows)
    value = lambda s: "".join(str(int(c)) for c in s if c.isdecimal())
    for i, text in rows:
        new = got[i].text
        assert len(got[i].entities) == 1 and new != text
        (e,) = got[i].entities
        assert value(new) != value(text)
        zero = [0x30, *SCRIPTS.values()][i // 100]
        assert {ord(c) - int(c) for c in new if c.isdecimal()} == {zero}  # in the mention's own digits
        if e.kind != "ip":
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
        assert value(new) == value(got[i % 100].text)  # one entity in whatever digits


def test_one_lone_entity_is_replaced_whatever_its_script(spark):
    rows = [(1, "Call ١٢٣-٤٥٦-٧٨٩٠ now."), (2, "nothing here")]
    got = {r.doc_id: r.text for r in replace(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert got[2] == rows[1][1] and not any(c in got[1] and got[1] == rows[0][1] for c in "١٢٣")
    assert re.fullmatch(r"Call [٠-٩]{3}-[٠-٩]{3}-[٠-٩]{4} now\.", got[1])


def test_an_entity_without_another_draw_does_not_stop_the_rest(spark):
    stuck = lambda kind, value, key, attempt=0, gender="": value if value == "0" else surrogate(kind, value, key, attempt, gender)
    found = spark.createDataFrame([("ssn", "0", ""), ("ssn", "123456789", "")], "kind string, value string, gender string")
    got = {r.value: r.new for r in settled(found, b"k", stuck).collect()}
    assert len(got) == 2 and got["0"] != "0"
