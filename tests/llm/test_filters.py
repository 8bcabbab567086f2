"""URL filter, pseudonyms and quality classifier."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupstream.llm import private, quality, urls
from dupstream.llm.common import table
from dupstream.llm.queries import URL_RULES
from tests.conftest import SF0001
from tests.llm.helpers import frame, odd_rows


def brute_rule(url):
    whole = url or ""
    at = whole.find("://")
    host, path = "", ""
    if at >= 0:
        m = re.match(r"([^/?#]*)([^?#]*)", whole[at + 3:], re.S)
        host, path = m[1].encode().lower().decode(), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://EXAMPLE.org/es/x?y", "https://a.example.org/en/12#t", "https://a.example.org/en/2",
        "https://notexample.org/en/1", "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://x.com?de/",
        "http://x.com:80/de/", "http://u@x.org", "http://x.org", "ftp://x.org/#/es/", "a://b://c.org/", "http://É.org/Ü",
        "http://m.casino-win.example.net/en/1", "http://www.casino-win9.example.net/en/7", "http://x.net/\n/de/"]
URLS += [f"http://site{i}.example.net/en/{i}" for i in range(30)] + [f"http://free-bets.example.net/en/{i}" for i in range(9)]


def test_hosts_paths_and_rules_as_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, score string")
    got = {r.page_id: r for r in urls.filter_urls(pages, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    verdicts = {u: got[i].verdict for i, u in enumerate(URLS)}
    assert verdicts["http://m.casino-win.example.net/en/1"] == "block"
    clean = [r.score for i, r in got.items() if "//site" in (URLS[i] or "")]
    alike = next(r.score for i, r in got.items() if URLS[i] == "http://www.casino-win9.example.net/en/7")
    assert alike > max(clean)                                                  # not in the table, but alike
    assert verdicts["http://site3.example.net/en/3"] == "allow"


def test_urls_of_one_label_null_ids_and_empty_tables(spark):
    schema = "page_id long, url string"
    got = urls.filter_urls(spark.createDataFrame([(None, "http://a.net/"), (1, "http://a.net/"), (1, "http://a.net/")], schema), URL_RULES)
    assert [(r.page_id, r.verdict) for r in got.orderBy("page_id").collect()] == [(None, "allow"), (1, "allow"), (1, "allow")]
    assert urls.filter_urls(spark.createDataFrame([], schema), URL_RULES).collect() == []


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", number))):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


SAMPLES = ["4111111111111111", "4111 1111 1111 1111", "378282246310005", "+1 (988) 555-2485", "988-555-2485", "123-45-6789",
           "10.1.2.3", "2024-02-29", "12/31/1999", "31.12.1999", "jo.Doe9@mail.example.com"]
LEFT = ["4111111111111112", "000-45-6789", "666-45-6789", "256.1.1.1", "2023-02-29", "13/31/1999", "4.0.", "version 3.", "1.2.3.4.5",
        "12345678901234567890", "1799-12-31", "a@b"]


def layout(value):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", value)))


def test_valid_values_change_within_their_format(spark):
    docs = frame(spark, [(i, f"see {s}, and {s}.") for i, s in enumerate(SAMPLES)])
    for r in private.pseudonymise(docs).collect():
        m = re.fullmatch(r"see (.*), and (.*)\.", r.text)
        assert m[1] == m[2] != SAMPLES[r.doc_id] and r.n_found == 2
        if r.kinds[0] != "ip":
            assert layout(m[1]) == layout(SAMPLES[r.doc_id])
        if r.kinds[0] == "card":
            assert luhn(m[1])
        if r.kinds[0] == "date":
            form = "%Y-%m-%d" if "-" in m[1] else "%m/%d/%Y" if "/" in m[1] else "%d.%m.%Y"
            datetime.datetime.strptime(m[1], form)
        if r.kinds[0] == "ip":
            assert all(0 <= int(x) <= 255 for x in m[1].split("."))


NEXT_TO = [("SSN-", "123-45-6789", ""), ("card-", "4111111111111111", ""), ("DOB-", "1999-12-31", ""), ("born.", "12/31/1999", ""),
           ("-", "jo@x.example.com", ""), ("...", "jo.Doe9@mail.example.com", ""), ("host.", "10.1.2.3", "."), ("(", "988-555-2485", ")"),
           ("((", "+1 (988) 555-2485", "))"), ("-", "123-45-6789", "-"), ("/", "31.12.1999", "/x"), ("-", "4111 1111 1111 1111", "-"),
           ("no 5/", "2024-02-29", "/7"), ("", "2024-02-29", ".5"), ("", "12/31/1999", "-"), ("", "123-45-6789", "/5")]
INTERVALS = ["2024-02-29/2024-03-01", "2024-02-29-2024-03-01", "12/31/1999-01/02/2000", "12/31/1999/01/02/2000", "31.12.1999-02.01.2000",
             "123-45-6789/187-65-4321"]
RUNS = ["1-123-45-6789", "123-45-6789-1", "5-2024-02-29", "2024-02-29-5", "1/12/31/1999", "12/31/1999/5",
        "1.31.12.1999", "31.12.1999.5", "2024-02-29-2024-03-01-2024", "1.10.1.2.3", "10.1.2.3.4"]


def test_neighbours_hide_no_valid_value(spark):
    rows = [(i, f"see {a}{v}{b} here") for i, (a, v, b) in enumerate(NEXT_TO)] + [(100 + i, v) for i, (_, v, _) in enumerate(NEXT_TO)]
    got = {r.doc_id: r for r in private.pseudonymise(frame(spark, rows)).collect()}
    for i, (a, v, b) in enumerate(NEXT_TO):
        alone = got[100 + i].text
        assert got[i].n_found == 1 and alone != v
        assert got[i].text == f"see {a}{alone}{b} here"                       # linked to the value that stands alone


def test_intervals_are_two_values_and_longer_runs_none(spark):
    rows = [(i, v) for i, v in enumerate(INTERVALS)] + [(100 + i, v) for i, v in enumerate(RUNS)]
    got = {r.doc_id: r for r in private.pseudonymise(frame(spark, rows)).collect()}
    assert {i: got[i].n_found for i in range(len(INTERVALS))} == {i: 2 for i in range(len(INTERVALS))}
    assert [got[100 + i].text for i in range(len(RUNS))] == RUNS


CARD = "4111 1111 1111 1111"
BESIDE = ["ref 1234 {} end", "2024 {}", "{} 2024", "1234 5678 {} 9012 3456", "{} {}", "1111-2222-{}", "{} 123", "12-{}", "id 55-{}x",
          "{} 2024-13-45", "1234 {}."]
OTHERS = [("{} 2024-02-29", "2024-02-29"), ("{} 988-555-2485", "988-555-2485"), ("{} 123-45-6789", "123-45-6789"),
          ("{} 10.1.2.3", "10.1.2.3"), ("1234 {} 378282246310005", "378282246310005"), ("{} 12/31/1999", "12/31/1999")]


def test_a_card_is_found_at_every_start_of_a_run(spark):
    rows = [(1, CARD), (2, CARD.replace(" ", "-")), (3, CARD.replace(" ", ""))]
    rows += [(100 * k + i, form.format(*[card] * 2)) for i, form in enumerate(BESIDE, 1) for k, (_, card) in enumerate(rows[:3], 1)]
    rows += [(1000 + i, form.format(CARD)) for i, (form, _) in enumerate(OTHERS)] + [(2000 + i, v) for i, (_, v) in enumerate(OTHERS)]
    rows += [(3000, "1234 5678 9012 3456 7890 1234"), (3001, "0000 0000 0000 0000 0000")]
    got = {r.doc_id: r for r in private.pseudonymise(frame(spark, rows)).collect()}
    for k in (1, 2, 3):
        for i, form in enumerate(BESIDE, 1):
            assert got[100 * k + i].text == form.format(*[got[k].text] * 2), (k, form)
            assert got[100 * k + i].kinds == ["card"] * form.count("{}") and got[100 * k + i].n_found == form.count("{}")
    for i, (form, other) in enumerate(OTHERS):
        assert got[1000 + i].text == form.replace(other, got[2000 + i].text).format(got[1].text) and got[1000 + i].n_found == 2
    assert all(got[d].n_found == 0 and got[d].text == t for d, t in rows if d >= 3000)


def test_equal_values_stay_linked_and_keys_matter(spark):
    docs = frame(spark, [(1, "4111111111111111"), (2, "4111 1111 1111 1111"), (3, "x 4111111111111111 y")])
    a = [re.sub(r"\D", "", r.text) for r in private.pseudonymise(docs).collect()]
    b = [re.sub(r"\D", "", r.text) for r in private.pseudonymise(docs, key="other").collect()]
    assert len(set(a)) == len(set(b)) == 1 and a != b


def test_what_is_not_valid_stays(spark):
    rows = [(i, f"see {s} here") for i, s in enumerate(LEFT)] + [(90, None), (91, ""), (None, "plain"), (92, "y" * 50_000)]
    got = private.pseudonymise(frame(spark, rows)).collect()
    assert sorted(((str(r.doc_id), r.text) for r in got), key=str) == sorted(((str(d), t) for d, t in rows), key=str)
    assert all(r.n_found == 0 and r.kinds == [] for r in got)
    assert private.pseudonymise(frame(spark, [])).collect() == []


@pytest.mark.parametrize("a,b", [(189, 773), (7, 3), (1, 5)])
def test_feistel_rounds_permute_the_domain(spark, a, b):
    pair = private.permuted((F.col("id") / b).cast("long"), F.col("id") % b, F.lit(a), F.lit(b), "key", "test")
    rows = spark.range(min(a * b, 5_000)).select(pair.alias("p")).collect()
    seen = {(r.p.l, r.p.r) for r in rows}
    assert len(seen) == len(rows) and all(0 <= x < a and 0 <= y < b for x, y in seen)


def graded_rows():
    rnd = random.Random(3)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "re") for b in ("na", "so", "ki", "pu", "te")]
    docs, grades = [], []
    for i in range(300):
        text = rnd.choices(plain, k=rnd.randint(20, 90))
        g = i % 3
        if g == 0:
            text = [w.upper() + "!!" for w in text]
        if g == 1:
            text[::9] = ["idiot"] * len(text[::9])
        docs.append((i, " ".join(text)))
        grades.append((i, g))
    return docs, grades


def test_grades_are_learned_in_order(spark):
    docs, grades = graded_rows()
    rated = [g for g in grades if g[0] < 200] + [(5000, 1), (None, 2), (3, None)]
    got = quality.grade(frame(spark, docs), spark.createDataFrame(rated, "doc_id long, grade int")).collect()
    held = [(r.expected_grade, r.kept, grades[r.doc_id][1]) for r in got if r.doc_id >= 200]
    assert sum(kept == (g == 2) for _, kept, g in held) / len(held) > 0.95
    means = [sum(e for e, _, g in held if g == k) / sum(g == k for _, _, g in held) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r.tail <= 1 and r.tail <= r.expected_grade <= 2 for r in got)


def test_classifier_takes_odd_rows_and_missing_ratings(spark):
    rows = odd_rows() + [(None, "x y")]
    none = spark.createDataFrame([], "doc_id long, grade int")
    got = quality.grade(frame(spark, rows), none).collect()
    assert len(got) == len(rows) and all(r.kept for r in got)
    one = spark.createDataFrame([(8, 2), (9, 2)], "doc_id long, grade int")
    assert all(r.kept for r in quality.grade(frame(spark, rows), one).collect())
    two = spark.createDataFrame([(8, 2), (9, 0)], "doc_id long, grade int")
    assert len(quality.grade(frame(spark, rows), two).collect()) == len(rows)
    assert quality.grade(frame(spark, []), two).collect() == []


def test_the_fit_may_use_2500_documents_of_a_grade(spark):
    docs = spark.range(5_400).selectExpr("id AS doc_id", "'some text' AS text")
    ratings = spark.range(5_400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS grade")
    assert {r.grade: r["count"] for r in quality.rated_sample(docs, ratings).groupBy("grade").count().collect()} == {0: 2500, 1: 2500}


def test_toxic_and_poor_rated_documents_are_rejected(spark):
    docs, labels = table(spark, SF0001, "documents"), quality.graded_labels(table(spark, SF0001, "labels"))
    got = quality.grade(docs, labels).join(labels, "doc_id").filter("grade < 2").collect()
    assert got and sum(not r.kept for r in got) / len(got) > 0.9


def test_quality_learns_from_long_documents_only(spark):
    rnd = random.Random(5)

    def text(n):
        good = n % 2
        words = ["window", "table", "garden", "river"] if good else ["pill", "casino", "bonus", "click"]
        return " ".join(rnd.choice(words) + rnd.choice("abcdef") for _ in range(3_000))
    docs = spark.createDataFrame([(n, text(n)) for n in range(80)], "doc_id long, text string")
    ratings = spark.createDataFrame([(n, 2 * (n % 2)) for n in range(60)] * 2 + [(200, 1), (None, 1), (61, None)],
                                    "doc_id long, grade int")
    assert docs.filter("octet_length(text) <= 16384").count() == 0
    kept = {r["doc_id"]: r["kept"] for r in quality.grade(docs, ratings).collect()}
    assert all(kept[n] == bool(n % 2) for n in range(60, 80))


def test_quality_sample_counts_ratings_and_documents_once(spark):
    docs = spark.createDataFrame([(n % 10, f"text {n}") for n in range(30)], "doc_id long, text string")
    ratings = spark.createDataFrame([(n, 0) for n in range(10)] * 3 + [(3, 9), (4, -1)], "doc_id long, grade int")
    got = sorted((r["grade"], r["doc_id"], r["text"]) for r in quality.rated_sample(docs, ratings, 4).collect())
    assert len(got) == 5 and [g[1:] for g in got if g[0] == 2] == [(3, "text 13")]


def test_quality_features_are_the_same_in_parts(monkeypatch):
    texts = ["", "one two two", "x" * 50, "Three, four! five", " ", "six seven"] * 3
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    grades = np.arange(len(texts)) % 3
    whole = quality.fit(data, offsets, grades, steps=5)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 10)
    parts = quality.fit(data, offsets, grades, steps=5)
    assert np.array_equal(whole.weights, parts.weights) and np.array_equal(whole.thresholds, parts.thresholds)
