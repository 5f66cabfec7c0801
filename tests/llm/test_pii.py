"""Personal data: plain spans against the stated patterns, disguised ones against known cases."""

import random
import re

from pyspark.sql import functions as F

from tidewright.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def stated(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn \
                    or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_plain_spans_of_random_texts():
    r = random.Random(9)
    parts = ["a.b", "@", "x-y", ".com", ".", " ", "-", "+", "49", "0", "255", "4111 1111 1111 1111", "(", ")", "1.2.3.4", "é", "0001", "%", "\n", "+44 20 7946 0958"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert pii.find_plain(text) == stated(text), text


def test_disguises():
    cases = [
        ("mail jo.doe [at] mail [dot] example (dot) com now", "email", "jo.doe [at] mail [dot] example (dot) com"),
        ("john at example dot com, fine", "email", "john at example dot com"),
        ("write jo.98 at mail2.example.com soon", "email", "jo.98 at mail2.example.com"),
        ("see user @ host.com", "email", "user @ host.com"),
        ("say jоhn＠exаmple。com ok", "email", "jоhn＠exаmple。com"),
        ("say jo​hn@exa​mple.com ok", "email", "jo​hn@exa​mple.com"),
        ("call plus four nine one five one two three four five six seven eight ok", "phone", "plus four nine one five one two three four five six seven eight"),
        ("ip one nine two dot one six eight dot zero dot one here", "ip", "one nine two dot one six eight dot zero dot one"),
        ("٤111 1111 1111 1111", "card", "٤111 1111 1111 1111"),
    ]
    for text, kind, want in cases:
        plain, spans = pii.find_all(text)
        assert [(k, text[s:e]) for k, s, e in spans if (k, s, e) not in plain] == [(kind, want)], text
    for text in ("meet at noon dot", "we are at home. one two three go", "at @home. we", "un dos tres", "she is at work. Dot came", "a point is at one", "Look at it (dot)", "look at example.com", "the 2.0 at example.com", "x1 at home.5"):
        assert pii.find_all(text) == ([], []), text


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "a@b.c " * 30_000), (4, "1" * 100_000), (5, "@" * 100_000 + "+" * 1000), (6, "x [at] y [dot] z"), (6, "x [at] y [dot] z")]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, spans string")
    got = pii.private_data(df, "text").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size("spans").alias("k"), pii.listed(F.col("spans")).alias("s")).collect()
    assert [tuple(g)[:6] for g in got] == [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (3, 30_000, 0, 0, 0, 30_000), (4, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (6, 0, 0, 0, 0, 1), (6, 0, 0, 0, 0, 1)]
    assert got[5]["s"] == "email:0:16"
    assert pii.private_data(df.limit(0), "text").count() == 0
