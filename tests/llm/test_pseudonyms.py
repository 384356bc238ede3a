import datetime as dt
import hashlib
import re
import time

from bankspark.llm.pseudonyms import ROUNDS, pseudonymise

KEY = "test key"


def feistel(values, radices, tag):
    h = -(-len(values) // 2)
    part = [list(values[:h]), list(values[h:])]
    rad = [radices[:h], radices[h:]]
    for k in range(1, ROUNDS + 1):
        x = (k + 1) % 2
        other = ",".join(map(str, part[1 - x]))
        d = hashlib.sha512("|".join([KEY, tag, str(k), other]).encode()).hexdigest()
        part[x] = [(v + int(d[4 * (j % 32):][:4], 16)) % rad[x][j] for j, v in enumerate(part[x])]
    return part[0] + part[1]


def chars(value, tag, letters, kept, after=""):
    def kind(j, c):
        return 1 if kept(j) else 10 if c.isdigit() else letters if c.isalpha() else 1

    first = lambda c: 48 if c.isdigit() else 97 if c.islower() else 65
    rad = [kind(j, c) for j, c in enumerate(value)]
    form = tag + "".join(c if r == 1 else str(r) for c, r in zip(value, rad)) + after
    got = feistel([0 if r == 1 else ord(c) - first(c) for c, r in zip(value, rad)], rad, form)
    return "".join(c if r == 1 else chr(first(c) + v) for c, r, v in zip(value, rad, got))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in pseudonymise(docs, KEY).orderBy("doc_id").collect()]


def one(spark, value):
    return run(spark, [value])[0][0]


def test_against_plain_python(spark):
    mail, phone, secret, card = "of.55@mail9.example.com", "+1 (017) 555-7713", "681c09b8e90e7e8c9575180f595f646cf2969054", "4845168114407329"
    body = chars(card, "card", 1, lambda j: j in (0, 15))[:-1]
    want = {
        mail: chars(mail.split("@")[0], "email", 26, lambda j: False, mail[mail.index("@"):]) + mail[mail.index("@"):],
        phone: chars(phone, "phone", 1, lambda j: j < 2),
        secret: chars(secret, "secret", 6, lambda j: False),
        secret.upper(): chars(secret.upper(), "secret", 6, lambda j: False),
        card: body + str(-luhn(body + "0") % 10),
        "97.51.17.173": ".".join(map(str, feistel([97, 51, 17, 173], [256] * 4, "address"))),
    }
    a, g, s = feistel([667 - 2, 12 - 1, 3456 - 1], [898, 99, 9999], "social")
    want["667-12-3456"] = f"{a + 1 + (a + 1 > 665):03d}-{g + 1:02d}-{s + 1:04d}"
    begin = dt.date(1985, 1, 1)
    at = (dt.date(2000, 2, 29) - begin).days
    hi, lo = feistel([at // 487, at % 487], [21, 487], "date1985")
    new = begin + dt.timedelta(hi * 487 + lo)
    want |= {"2000-02-29": new.isoformat(), "02/29/2000": f"{new:%m/%d/%Y}", "29/02/2000": f"{new:%d/%m/%Y}", "29.02.2000": f"{new:%d.%m.%Y}"}
    text = "Ü " + " é, ".join(want) + "."
    got, found, replaced = run(spark, [text])[0]
    assert got == "Ü " + " é, ".join(want.values()) + "."
    assert found == replaced == len(want)
    assert all(k != v for k, v in want.items())
    assert luhn(want[card]) == 0


def test_links_and_leaves_invalid_values(spark):
    kept = ["9807915762804490", "300.1.1.1", "1.2.3.4.5", "2001-02-29", "31/31/2000", "000-12-3456", "666-12-3456", "1850-01-01",
            "123456", "deadbeef" * 3, "x4845168114407329", "3.4845168114407329", "a@b", "@", "12:30"]
    text = "; ".join(kept)
    assert run(spark, [text])[0][0] == text
    a, b = run(spark, ["card 4845168114407329 here", "4845168114407329 4845168114407329"])
    assert b[0].split() == [a[0].split()[1]] * 2


def test_permutes_dates_one_to_one(spark):
    days = [(dt.date(1985, 1, 1) + dt.timedelta(k)).isoformat() for k in range(10227)]
    got = run(spark, [" ".join(days)])[0][0].split()
    assert sorted(got) == sorted(days) and sum(a == b for a, b in zip(days, got)) < 20


def test_edges(spark):
    assert run(spark, [None, "", "no values", "x" * 300000 + " 1"]) == [(None, 0, 0), ("", 0, 0), ("no values", 0, 0), ("x" * 300000 + " 1", 0, 0)]
    assert run(spark, []) == []
    docs = spark.createDataFrame([(None, "97.51.17.173", 7)] * 2, "doc_id long, text string, n_found int")
    rows = pseudonymise(docs, KEY).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_found == 1
    long = " ".join(["4845168114407329"] * 5000)
    assert len(set(run(spark, [long])[0][0].split())) == 1
    assert re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", one(spark, "4845-1681-1440-7329")) and luhn(one(spark, "4845-1681-1440-7329").replace("-", "")) == 0


def test_every_pattern_with_a_million_repeats(spark):
    n = 1_000_000
    texts = [
        "a@" + "b." * n + "c", "a@" + "b" * n + ".c", "a" * n + "@b.c", "a." * n, "a@" * n, "1." * n, "1.1.1.1." * (n // 4), "+1 " + "12-" * n, "(123) " * n,
        "+" * n, "2000-" * n, "01/" * n, "123-45-" * n, "1234 " * n, "1" * n, "ab12" * n, "AB" * n,
    ]
    started = time.perf_counter()
    got = run(spark, texts)
    assert time.perf_counter() - started < 120
    assert [len(t) for t, *_ in got] == [len(t) for t in texts]
    assert got[0][1:] == (1, 1) and got[0][0].endswith("@" + "b." * n + "c")
    assert all(old == new for old, (new, _, replaced) in zip(texts, got) if not replaced)
