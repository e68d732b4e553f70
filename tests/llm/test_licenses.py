from orrery.llm import licenses

MIT = licenses.TEMPLATES["MIT"][1]


def plain_dice(a, b):
    grams = lambda t: [tuple(x) for x in zip(t, t[1:])]
    x, y = grams(a), grams(b)
    left, shared = list(y), 0
    for g in x:
        if g in left:
            left.remove(g)
            shared += 1
    return 2 * shared / (len(x) + len(y)) if x or y else 0.0


def brute(text):
    words = lambda t: licenses.normalised(t.encode()).split()
    lines = [words(x) for x in text.split("\n")]
    parts, cur = [], []
    for i, w in enumerate([*lines, []]):
        if w:
            cur.append(i)
        elif cur:
            parts.append(cur)
            cur = []
    units = [("line", i, i + 1) for p in parts for i in p] + [("paragraph", p[0], p[-1] + 1) for p in parts if len(p) > 1]
    units += [("text", parts[0][0], parts[-1][-1] + 1)] if len(parts) > 1 else []
    out = set()
    for unit, a, b in units:
        w = [x for line in lines[a:b] for x in line]
        best = min((-plain_dice(w, words(t)), name) for name, (_, ts) in licenses.TEMPLATES.items() for t in ts)
        if -best[0] >= licenses.THRESHOLD:
            out.add((best[1], unit, a, b, round(-best[0], 9)))
    return out


def texts():
    long = MIT[1].replace(", ", ",\n")
    return [
        None, "", "\n \n", "no licence here", MIT[0], "RELEASED  under the mit license", "intro\n" + MIT[0] + "\nmore words",
        long, "Title\n\n" + long + "\n\nend of it", MIT[1].replace("copy", "duplicate"), "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0!",
        "licensed under the apache license version 2 0 or later", "é " * 500, "x " * 200_000 + "\n" + MIT[0],
    ]


def test_scan_matches_brute_force(spark):
    rows = list(enumerate(texts())) + [(4, MIT[0]), (None, MIT[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string").repartition(3)
    got = sorted(((r.doc_id, r.license, r.unit, r.start_line, r.end_line, round(r.dice, 9)) for r in licenses.scan(df).collect()), key=str)
    want = sorted(((i, *f) for i, t in rows for f in brute((t or "")[-5000:] if t and len(t) < 10000 else (t or "")[-0:] if not t or len(t) < 10**5 else "\n" + MIT[0])), key=str)
    assert got == want
    assert licenses.scan(df.limit(0)).count() == 0
    per = {r.doc_id: r for r in licenses.documents(df, licenses.scan(df)).collect()}
    assert per[4].licenses == ["MIT"] and per[4].permissive and per[11].permissive is False and per[3].licenses is None


def test_notices_inside_lines_and_across_paragraphs():
    m = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    inside = "Copyright 2020 X. Released under the MIT License. See LICENSE for details"
    assert m.scan(inside.encode()) == [("MIT", "run", 0, 1, 1.0)]
    prose = "some other words " * 200
    assert m.scan((prose + inside + prose).encode()) == [("MIT", "run", 0, 1, 1.0)]
    bsd = licenses.TEMPLATES["BSD-2-Clause"][1][1].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ")
    assert m.scan(f"Title\n\n{prose}\n\n{bsd}\n\n{prose}".encode()) == [("BSD-2-Clause", "run", 4, 9, 1.0)]
    assert m.scan(f"{inside} {MIT[1]} {prose} Licensed under CC BY-NC 4.0.".encode()) == [("MIT", "run", 0, 1, 1.0)] * 2 + [("CC-BY-NC-4.0", "run", 0, 1, 1.0)]


def test_relatives_keep_their_own_names():
    m = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    for name, (_, forms) in licenses.TEMPLATES.items():
        for t in forms:
            assert m.scan(t.encode()) == [(name, "line", 0, 1, 1.0)], t
            inside = "Some words before it stand here " * 20 + t + " and some others after it" * 20
            assert [f[:2] for f in m.scan(inside.encode())] == [(name, "run")], t


def test_longest_of_equally_near_runs():
    m = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    bsd = licenses.TEMPLATES["BSD-3-Clause"][1][1].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ")
    prose = "some other words " * 200
    assert m.scan(f"{prose}\n\n{bsd}\n\n{prose}".encode()) == [("BSD-3-Clause", "run", 2, 9, 1.0)]
