import re

from lociframe.llm import surrogates
from lociframe.llm.common import table

TEXTS = [
    "write to Ann.Lee7@mail3.example.com or ann.lee7@MAIL3.example.com, not bob@x.org.",
    'call +1 (017) 555-7713 or +10175557713 97.51.17.173 9807915762804490 and 4111 1111 1111 1111; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    "Mr. John Smith met Mrs. Mary Smith, Dr. Smith and Frau Müller. МИР: г-н Иванов, г-жа Иванова. Mr SMITH!",
    "10.0.0.7 and 192.168.1.9; DE89 3704 0044 0532 0130 00; 078-05-1120; (212) 555-0100. Order 12345678 of 2019-01-02, v1.2.3.4.5, 99.5%",
    None, "", "nothing here | at all = 5", "a@b.co",
]


def run(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row_key string")
    rows = surrogates.replace(docs, key, count="n").collect()
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {"doc_id", "text", "row_key", "n"}
    return {r.doc_id: r for r in rows}


def test_types_formats_and_coreference(spark):
    got = run(spark, TEXTS)
    assert [got[i].n for i in range(8)] == [3, 6, 9, 5, 0, 0, 0, 1]
    assert [got[i].text for i in (4, 5, 6)] == TEXTS[4:7]
    mail = re.findall(r"[\w.]+@[\w.]+\w", got[0].text)
    assert mail[0] == mail[1] != mail[2] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@m\w{10}\.example\.(com|net|org)", mail[0])
    m = re.fullmatch(r'call (\+1\d? ?\(\d{3}\) \d{3}-\d{4}) or (\+\d{11}) (\d+(?:\.\d+){3}) (\d{16}) and (\d{4} \d{4} \d{4} \d{4}); token = "([0-9a-f]{40})"', got[1].text)
    assert m and re.sub(r"[^+\d]", "", m[1]) == m[2] != "+10175557713"
    luhn = lambda t: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(re.sub(r"\D", "", t)))) % 10
    assert luhn(m[5]) == 0 and luhn(m[4]) == luhn("9807915762804490")
    for old in ("97.51.17.173", "9807915762804490", "4111 1111", "04dbebab"):
        assert old not in got[1].text
    n = re.fullmatch(r"Mr\. (\w+o) (\w+) met Mrs\. (\w+a) (\w+), Dr\. (\w+) and Frau (\w+)\. МИР: г-н (\w+ов), г-жа (\w+ова)\. Mr ([A-Z]+)!", got[2].text)
    assert n, got[2].text
    assert n[2] == n[4] == n[5] == n[9].capitalize() and n[6] != n[2] and n[1] != "John" and n[2] != "Smith" and n[7] != "Иванов"
    t = got[3].text
    assert re.fullmatch(r"10\.\d+\.\d+\.\d+ and 192\.168\.\d+\.\d+; DE\d\d( \d{4}){4} \d\d; \d{3}-\d\d-\d{4}; \(\d{3}\) \d{3}-\d{4}\. Order 12345678 of 2019-01-02, v1\.2\.3\.4\.5, 99\.5%", t), t
    assert run(spark, TEXTS)[0].text == got[0].text and run(spark, TEXTS, "other")[0].text != got[0].text


def test_collisions_are_settled(spark):
    """Few addresses in a small private block: candidates must collide, surrogates must not."""
    texts = [f"192.168.{i // 200}.{i % 200}" for i in range(3000)]
    got = run(spark, texts)
    new = [got[i].text for i in range(len(texts))]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)
    assert all(re.fullmatch(r"192\.168\.\d+\.\d+", t) for t in new)


def test_whole_names_and_mentions(spark):
    texts = [
        "Frau Anna Maria Schmidt kam. Later Schmidt's dog met SCHMIDT and Anna; schmidtlike Schmidts stay.",
        "Mr John P. Smith and Dr. J. Smith, Herr Dr. Karl von der Heide. Then Heide left.",
        "иван.петров@почта.рф, " + "q" * 70 + "@x.org; call 555-123-4567, 0171 2345678 or 0171/234567 99.",
        "Schmidt alone stays. Order 12-345-6789 of 01/2019.",
    ]
    got = run(spark, texts)
    t = got[0].text
    m = re.fullmatch(r"Frau (\w+) (\w+) (\w+) kam\. Later (\w+)'s dog met (\w+) and (\w+); schmidtlike Schmidts stay\.", t)
    assert m and m[4] == m[3] and m[5] == m[3].upper() and m[6] == m[1] and not {"Anna", "Maria", "Schmidt", "SCHMIDT"} & set(m.groups()), t
    t = got[1].text
    m = re.fullmatch(r"Mr (\w+) ([A-Z])\. (\w+) and Dr\. ([A-Z])\. (\w+), Herr Dr\. (\w+) von der (\w+)\. Then (\w+) left\.", t)
    assert m and m[3] == m[5] and m[7] == m[8] and m[2] != "P" and m[4] != "J" and not {"John", "Smith", "Karl", "Heide"} & set(m.groups()), t
    t = got[2].text
    assert not any(x in t for x in ("иван", "петров", "почта", "q" * 20, "555-123-4567", "2345678", "234567")), t
    assert re.match(r"[а-я]{4}\.[а-я]{6}@m", t)
    assert got[3].text == texts[3]


def test_full_pools_end(spark):
    """More forms than half of their pool: later attempts leave it."""
    phones = [f"+12{i:03}" for i in range(700)]
    blocks = [f"192.168.{i // 254 + 1}.{i % 254 + 1}" for i in range(40_000)]
    mails = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    cards = ["4111111111111111", "378282246310005"]
    rows = [("phone", t) for t in phones] + [("ip", t) for t in blocks] + [("email", t) for t in mails] + [("card", t) for t in cards] + [("secret", "-" * 16)]
    got = {(r.kind, r.text): r.s for r in surrogates.assign(spark.createDataFrame(rows, "kind string, text string"), "k").collect()}
    assert got.keys() == set(rows)
    assert len({(k, s) for (k, _), s in got.items()}) == len(rows) and not {(k, s) for (k, _), s in got.items()} & set(rows)
    assert all(re.fullmatch(r"\+12\d{3,}", got["phone", t]) for t in phones) and any(len(got["phone", t]) > 6 for t in phones)
    assert all(re.fullmatch(r"192\.168\.\d+\.\d+|10\.\d+\.\d+\.\d+", got["ip", t]) for t in blocks)
    one = spark.createDataFrame([("phone", "+12 34 5", "+1267890")], "kind string, raw string, s string")
    assert one.select(surrogates._render(*map(one.__getitem__, ("kind", "raw", "s")))).first()[0] == "+12 67 890"
    late = surrogates.candidates(spark.createDataFrame([("ip", "10.0.0.1"), ("card", cards[0])], "kind string, text string"), "k", 30).collect()
    assert re.fullmatch(r"fd[0-9a-f]{2}(:[0-9a-f]{4}){7}", late[0].s) and len(late[1].s) == 16 + 31 - surrogates.STAY
    assert spark.range(1).select(*[surrogates.luhn(surrogates.F.lit(c)) for c in (late[1].s, cards[0])]).first() == (0, 0)


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(None, TEXTS[0]), (None, TEXTS[0]), (1, TEXTS[0]), (1, TEXTS[1]), (2, "x" * 200_000 + " a@b.co")], "doc_id long, text string").repartition(3)
    rows = surrogates.replace(docs).collect()
    assert len(rows) == 5 and len({r.text for r in rows}) == 3
    assert surrogates.replace(docs.limit(0)).count() == 0


def test_planted_entities_go_and_clean_documents_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    old = {r.doc_id: r.text for r in docs.collect()}
    seen = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-f]{40}\b")
    for r in surrogates.replace(docs).collect():
        mine = seen.findall(old[r.doc_id])
        if not mine:
            assert r.text == old[r.doc_id]
        for x in mine:
            assert x not in r.text, x


def out_of(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.replace(rows).orderBy("doc_id").collect()]


def test_initials_stay_distinct(spark):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    got = out_of(spark, *[f"Mr. {c}. Bond called." for c in letters])
    new = [t.split()[1] for t in got]
    assert len(set(new)) == 26 and all(n[0] != c and n[0] in letters for n, c in zip(new, letters))
    assert len({t.split()[2] for t in got}) == 1


def test_one_surrogate_under_all_titles(spark):
    a, b, c, d = out_of(spark, "Frau Anna Schmidt kam, dann Dr. Anna Schmidt.", "Mr. John Smith and Mr. John met Prof. Smith.", "Dr. Anna Weber", "Herr Schmidt")
    one = a.split()
    assert one[1:3] == [one[-2], one[-1].rstrip(".")] and one[1].endswith("a")
    two = b.replace(".", "").split()
    assert two[1] == two[5] and two[2] == two[-1] and two[1] != two[2]
    assert c.split()[1] == one[1] and d.split()[1] == one[2]


def test_account_numbers_keep_their_check(spark):
    def rest(iban):
        moved = iban[4:] + iban[:4]
        return int("".join(str(int(x, 36)) for x in moved)) % 97

    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NO9386011117947", "DE00370400440532013000"]
    got = out_of(spark, *[f"Pay to {i} now" for i in ibans], "Pay to DE89 3704 0044 0532 0130 00 now")
    new = [t.removeprefix("Pay to ").removesuffix(" now") for t in got]
    assert all(n != i and n[:2] == i[:2] and len(n) == len(i) and rest(n) == rest(i) for n, i in zip(new, ibans))
    assert new[-1].replace(" ", "") == new[0] and [len(x) for x in new[-1].split()] == [4, 4, 4, 4, 4, 2]
    assert [rest(i) for i in ibans[:4]] == [1] * 4
