"""The license scan against all rules run without gate or keyword."""

from __future__ import annotations

import re

from factloom.llm import licenses
from tests.llm import brute

LINES = [
    "http://mozilla.org/mpl/1.1", "https://www.mozilla.org/mpl/2.0", "http://mozilla.org/mpl", "https://www.eclipse.org/legal/epl-v10", "http://eclipse.org/legal/epl-v20",
    "http://scripts.sil.org/ofl", "http://www.w3.org/consortium/legal", "https://latex-project.org/lppl", "https://joinup.ec.europa.eu/software/page/eupl", "http://opensource.apple.com/apsl",
    "https://mariadb.com/bsl11", "Expat License", "X11 licence", "Creative Commons Attribution 1.0", "Distributed under the Expat license", "CC BY 4.0", "cc by-nc-sa", "no such thing",
]


def ungated(text, monkeypatch):
    monkeypatch.setattr(licenses, "GATES", [""])
    monkeypatch.setattr(licenses, "rules", lambda plain=licenses.rules(): [(p, "", x, m, s) for p, _, x, m, s in plain])
    return brute.license_row(text)


def test_no_detection_is_lost_before_the_rules(spark, monkeypatch):
    got = {r.text: (r.base_labels, r.labels, r.score) for r in licenses.scan(spark.createDataFrame([(t,) for t in LINES], "text string")).collect()}
    want = {}
    for text in LINES:
        with monkeypatch.context() as m:
            want[text] = ungated(text, m)[-3:]
    assert got == want
    assert all(got[t][1] for t in LINES[:-1]) and got[LINES[-1]][1] == ""


def test_every_match_holds_a_keyword_and_a_gate():
    gates, text = licenses.gates(), "\n".join(LINES).lower()
    for _, _, pattern, _, _ in licenses.rules():
        own = licenses.keywords(pattern)
        assert all(k and any(g in k for g in gates) for k in own)
        assert all(any(k in m[0] for k in own) for m in re.finditer(pattern, text, re.ASCII))
