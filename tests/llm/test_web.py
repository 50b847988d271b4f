import base64
import datetime as dt
import hashlib

from quillmask.llm import licenses, url_filter, warc
from quillmask.llm.common import shared_path

PAGES = "page_id long, url string, html string, urlkey string, kind string, p long"


def pages(spark):
    body = "<p>é😀 " + "x" * 200_000
    rows = [(1, "http://www.Example.com/a", "one"), (2, "http://b.example.com:8080/A?q=1", "one"), (3, None, "one"), (4, "not a url", None), (5, "http://c.org", ""), (None, "http://c.org/x", "one"), (None, "http://c.org/y", "alone"), (7, "http://c.org", body), (8, "https://user@C.org./z\n", "two"), (8, "https://user@C.org./z\n", "two")]
    return spark.createDataFrame([(*r, "k", "x", 9) for r in rows], PAGES)


def test_archives_round_trip(spark):
    df = pages(spark)
    got = sorted((tuple(x) for x in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    text = [x.html or "" for x in df.collect()]
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    kinds = {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), 7: ("response", None), 8: ("response", None)}
    want = []
    for x, t in zip(df.collect(), text):
        kind = kinds.get(x.page_id, ("revisit", 3) if t == "one" else ("response", None))
        want.append((x.page_id, len(t.encode()), digest(t), *kind))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.where("false")).count() == 0


def test_payloads_and_small_ones(spark):
    df = pages(spark)
    folder = shared_path(spark, "warc-test")
    captures = warc.write_archives(df, folder, min_bytes=4)
    records = warc.read_records(captures, folder).collect()
    assert all(x.record_type == "response" for x in records)
    assert sorted(x.payload.decode() for x in records) == sorted(x.html or "" for x in df.collect())


def test_index_finds_every_key(spark, monkeypatch):
    """Small blocks, a key over several blocks and files, keys that aren't there."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 11}", f"page {i}") for i in range(200)] + [(1000 + i, "http://hot.example.org/", f"hot {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_path(spark, "index-test")
    captures = warc.write_archives(df, folder)
    directory = warc.write_index(captures, folder)
    assert directory.count() > 20
    for url in ("http://hot.example.org/", "http://h3.example.org/p5", "http://www.h3.example.org/p5", "http://absent.example.org/"):
        found = warc.look_up(spark.createDataFrame([(url,)], "url string"), directory, folder).collect()
        assert {x.page_id for x in found} == {i for i, u, _ in rows if warc.url_key(u) == warc.url_key(url)}
    assert warc.url_key("http://www.Example.com:80/A?b") == "com,example)/a?b" and warc.url_key(None) == "-" and " " not in warc.url_key("a b")


def test_url_list_over_time(spark):
    day = lambda n: dt.date(2024, 1, n)
    events = [("bad.example", "add", day(5)), ("bad.example", "add", day(6)), ("bad.example", "remove", day(10)), ("bad.example", "add", day(20)), ("ok.example/Ads/", "add", day(1)), ("both.example", "remove", day(3)), ("both.example", "add", day(3)), (None, "add", day(1)), ("x.example", "add", None), ("x.example", "other", day(1)), ("sub.bad.example", "add", day(1))]
    events = spark.createDataFrame(events, "entry string, action string, at date")
    rows = [
        ("http://BAD.example/x", day(4), False, None), ("http://a.bad.example./x", day(5), True, "bad.example"), ("https://u@bad.example:8/", day(9), True, "bad.example"), ("http://bad.example", day(10), False, None),
        ("http://bad.example", day(25), True, "bad.example"), ("http://notbad.example", day(6), False, None), ("http://ok.example/ads/1?x", day(2), True, "ok.example/ads"), ("http://ok.example/adsx", day(2), False, None),
        ("http://both.example", day(4), False, None), ("http://x.example", day(4), False, None), (None, day(4), False, None), ("http://bad.example", None, False, None), ("mailto:x", day(4), False, None),
        ("http://z.sub.bad.example", day(7), True, "sub.bad.example"), ("http://ok.example/" + "a/" * 5000, day(2), False, None),
    ]
    df = spark.createDataFrame([(u, f, "kept", 1) for u, f, _, _ in rows] * 2, "url string, fetched date, valid string, blocked int")
    got = url_filter.screen(df, events)
    assert got.columns == ["url", "fetched", "valid", "blocked", "n_entries", "entry", "since"] and got.count() == len(df.collect())
    seen = {(x.url, x.fetched): (x.blocked, x.entry, x.n_entries, x.valid) for x in got.collect()}
    for u, f, blocked, entry in rows:
        assert seen[u, f][:2] == (blocked, entry) and seen[u, f][3] == "kept", u
    assert seen["http://z.sub.bad.example", day(7)][2] == 2
    since = {(x.url, x.fetched): x.since for x in got.collect()}
    assert since["https://u@bad.example:8/", day(9)] == day(5) and since["http://bad.example", day(25)] == day(20)
    valid = {x.entry: [tuple(v) for v in x.valid] for x in url_filter.intervals(events).collect()}
    assert valid == {"bad.example": [(day(5), day(10)), (day(20), None)], "ok.example/ads": [(day(1), None)], "sub.bad.example": [(day(1), None)]}
    assert url_filter.screen(df, events.where("false")).where("blocked").count() == 0
    assert url_filter.screen(df.where("false"), events).count() == 0


def predicted(text):
    """The classifier in plain Python: (family, its probability, its coverage), of any paragraph."""
    import numpy as np

    classes, weights, intercept, _ = licenses.model()
    w = licenses.words(text)
    known = [g for g in {*w, *licenses.bigrams(w)} if g in weights]
    z = sum((np.array(weights[g]) for g in known), np.zeros(len(classes))) / max(1.0, len(known) ** 0.5) + np.array(intercept)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    family = classes[int(z.argmax())]
    cover = max((len(licenses.bigrams(w) & licenses.bigrams(licenses.words(t))) / len(licenses.bigrams(licenses.words(t))) for t in licenses.TEMPLATES.get(family, ())), default=0)
    return family if p.max() >= licenses.PROBABILITY else licenses.UNKNOWN, float(p.max()), cover


def test_licenses(spark, odd, none):
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.OTHERS + ["Prose before. Released under the MIT License. Prose after it.", "RELEASED UNDER THE MIT LICENSE", "mit", "under the license"]
    df = spark.createDataFrame([(i, "intro\n\n" + t + "\n\nend") for i, t in enumerate(lines)], "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan(df).collect()}
    for i, t in enumerate(lines):
        want = predicted(t)
        assert (want[0] == licenses.UNKNOWN) == (i not in got), t
        if i in got:
            assert got[i].family == want[0] and abs(got[i].probability - want[1]) < 1e-9 and abs(got[i].coverage - want[2]) < 1e-9 and got[i].paragraph == got[i].last == 2
    for i, (family, t) in enumerate((f, t) for f, ts in licenses.TEMPLATES.items() for t in ts):
        assert got[i].confirmed and got[i].family == family, t
    first = sum(map(len, licenses.TEMPLATES.values()))
    assert not set(got) & set(range(first, first + len(licenses.OTHERS)))
    assert got[first + len(licenses.OTHERS)].confirmed and got[first + len(licenses.OTHERS) + 1].confirmed
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_no_row_is_lost_to_anchors(spark):
    """Every line of a whole table by the model alone, without the gate: the same rows of known families."""
    from quillmask.llm.common import table

    d = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["mit und mit der Zeit", "licenza pubblica", "the file of this software", "public general commons", "x\nversion 3 of the license\nmit"])], d.schema)
    rows = d.union(more)
    want = {(x.doc_id, i): predicted(line)[0] for x in rows.collect() for i, line in enumerate(x.text.split("\n"))}
    got = {(x.doc_id, x.paragraph): x.family for x in licenses.scan(rows).where("paragraph = last").collect()}
    assert got == {k: f for k, f in want.items() if f != licenses.UNKNOWN} and got


def test_left_out_texts():
    """What is told right of texts that the model hasn't seen; no sentence that is no notice comes near a family."""
    _, _, _, right, worst = licenses.trained()
    assert right >= 0.8 and worst < licenses.PROBABILITY


def test_wrapped_notices(spark):
    """Notices over several lines, as comments, after other lines, two in a text; a blank line parts paragraphs."""
    bsd = "Redistribution and use in source and binary forms, with or without\n{0}modification, are permitted provided that the following conditions are met"
    gpl = "{0}This program is free software: you can redistribute it\n{0}and/or modify it under the terms of the GNU General\n{0}Public License as published by the Free Software Foundation"
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in it"
    apache = 'Licensed under the Apache License,\nVersion 2.0 (the "License"); you may not use this\nfile except in compliance with the License.'
    texts = [bsd.format(""), "# " + bsd.format("# "), "/*\n" + gpl.format(" * ") + "\n */", "intro\n\n" + bsd.format("") + "\n\n" + gpl.format(""), bsd.format("\n"), "Released under the MIT License.\nMore prose.", mit, "Prose first.\n" + apache, mit + "\n" + apache]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted({(x.doc_id, x.paragraph, x.family[:3]) for x in licenses.scan(df).where("confirmed").collect()})
    assert got == [(0, 0, "bsd"), (1, 0, "bsd"), (2, 1, "gpl"), (3, 2, "bsd"), (3, 5, "gpl"), (5, 0, "mit"), (6, 0, "mit"), (7, 0, "apa"), (8, 0, "apa"), (8, 0, "mit")]


def test_planted_license_lines(spark):
    from pyspark.sql import functions as F

    from quillmask.llm.common import table

    d = table(spark, "/root/testdata/sf0.1", "documents")
    planted = {x.doc_id for x in d.where(F.col("text").rlike("(?i)licen[sc]e|licensed")).collect()}
    assert {x.doc_id for x in licenses.scan(d).where("confirmed").collect()} == planted
