import math
import re
import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import helpers

from quantloom.llm import licences as lc


def verdict(g, model):
    """Family of a set of n-grams by loops."""
    f = [i for i, x in enumerate(model["features"]) if x in g]
    if not f:
        return lc.UNKNOWN
    z = [(sum(model["w"][i][k] for i in f) + model["b"][k]) / model["temperature"] for k in range(len(model["families"]))]
    p = [math.exp(v - max(z)) for v in z]
    k = z.index(max(z))
    name = model["families"][k]
    match = max((len(g & lc.grams(t)) / len(lc.grams(t)) for t in lc.TEMPLATES.get(name, [])), default=0)
    return name if p[k] / sum(p) >= lc.CERTAIN and match >= lc.CONFIRM else lc.UNKNOWN


def plain(text, model):
    """Families of lines and wrapped notices of a text by loops."""
    out, anchors = [], set(lc.anchors(model["features"]))
    for block in re.split(lc.BLANK, text):
        lines = block.split("\n")
        own = [verdict(lc.grams(x), model) for x in lines]
        out += [f for f in own if f != lc.UNKNOWN]
        w = [lc.words(x) for x in lines]
        near = [lc.grams(" ".join((w[i - 1][-2:] if i else []) + w[i] + (w[i + 1][:2] if i + 1 < len(w) else []))) for i in range(len(w))]
        last = None
        for a in range(0, len(lines), lc.SPAN):
            here = range(a, min(len(lines), a + 2 * lc.SPAN))
            # Only lines with an anchor give n-grams.
            rest = [near[i] for i in here if own[i] == lc.UNKNOWN and set(w[i]) & anchors]
            f = verdict(set().union(*rest), model)
            if f != lc.UNKNOWN and f != last:
                out.append(f)
            last = f
    return out


def check(spark, docs):
    model = lc.train()
    got = {}
    for r in lc.scan(docs).collect():
        got.setdefault(r.doc_id, r)
    for r in docs.collect():
        fams = plain(r["text"] or "", model)
        g = got[r["doc_id"]]
        assert (g.n_licences, list(g.families)) == (len(fams), sorted(set(fams))), (g, fams)
    return got


WRAPPED = {
    "This work is licensed under the GNU General\nPublic License, version 3.": ["gpl"],
    "# Licensed under the Apache\n# License, Version 2.0.\nReleased under the MIT License.": ["apache", "mit"],
    "Redistribution and use in\nsource and binary forms,\nwith or without\nmodification, are permitted.": ["bsd"],
    "This work is licensed under the GNU General\n\nPublic License, version 3.": [],
    "word\n" * 13 + "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\nsoftware and associated documentation files." + "\nword" * 40: ["mit"],
    "word\n" * 13 + "Released under the MIT License." + "\nword" * 5: ["mit"],
}


def test_wrapped_notices(spark):
    rows = [(i, t, *[None] * 19) for i, t in enumerate(WRAPPED)]
    got = check(spark, spark.createDataFrame(rows, helpers.SCHEMA))
    for i, (t, want) in enumerate(WRAPPED.items()):
        assert (list(got[i].families), got[i].n_licences) == (want, len(want)), (t, got[i])


def test_odd_rows_and_families(spark):
    lines = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "THE DRIVER showed a license to the public."]
    rows = helpers.odd_rows() + [(100 + i, "Anther thea.\n" + x + "\nonwhat", *[None] * 19) for i, x in enumerate(lines)]
    got = check(spark, spark.createDataFrame(rows, helpers.SCHEMA))
    assert [list(got[100 + i].families) for i in range(5)] == [["gpl"], ["cc-by-nc"], ["mit"], ["apache"], []]


def test_table(spark):
    got = check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(r.n_licences for r in got.values())


def test_every_template_is_its_own_family():
    model = lc.train()
    for f, ts in lc.TEMPLATES.items():
        for t in ts:
            assert plain(t, model) == [f], (f, t, plain(t, model))
    assert not any(plain(t, model) for t in lc.OTHERS)


def test_empty(spark):
    assert lc.scan(helpers.none(spark)).collect() == []
