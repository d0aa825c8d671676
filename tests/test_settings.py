import datetime

import pytest
import yaml
from tree import SETTINGS

from marginalia import settings


def changed(path, value):
    top = yaml.safe_load(SETTINGS)
    at = top
    for p in path[:-1]:
        at = at[p]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return yaml.safe_dump(top)


def test_loads(tmp_path):
    s = settings.parse(SETTINGS, tmp_path)
    assert s.languages["json"] == ("config", "json") and s.terms[1].in_code and s.threshold == 0.8 and s.root == tmp_path / "."


BAD = [(("stale_image_days",), 0), (("stale_image_days",), "x"), (("duplication", "threshold"), 1.5), (("duplication", "shingle_size"), 1), (("duplication", "shingle_size"), None), (("unknown",), 1), (("registry_prefixes",), []), (("languages", "bash"), {"kind": "x"}), (("languages", "bash"), {"kind": "shell", "parser": "x"}), (("links", "skip"), [{"pattern": "(", "why": "x"}]), (("terminology",), [{"from": "a b", "to": "c"}, {"from": "A  B", "to": "d"}]), (("drift_budget", "stale_image_refs"), -1), (("content_root",), ""), (("links", "owned_domains"), [])]


@pytest.mark.parametrize("path,value", BAD)
def test_rejects(path, value, tmp_path):
    with pytest.raises(settings.SettingsError):
        settings.parse(changed(path, value), tmp_path)


def test_not_yaml(tmp_path):
    with pytest.raises(settings.SettingsError):
        settings.parse("a: [", tmp_path)


def test_discovery(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / "settings.yaml").write_text(SETTINGS)
    assert settings.discover(inner, {}) == tmp_path / "settings.yaml"
    assert settings.discover(inner, {"MARGINALIA_ROOT": str(tmp_path / "a")}) == tmp_path / "settings.yaml"
    with pytest.raises(settings.SettingsError, match="tried"):
        settings.discover(inner, {"MARGINALIA_SETTINGS": str(inner / "x.yaml")})


def test_ledger(tmp_path):
    good = "issues:\n  - {problem: p, key: k, note: n, added: 2025-01-02}\nnotes:\n  - {where: w, note: n, added: '2025-01-03'}\n"
    book = settings.parse_ledger(good)
    assert book.issues == (("p", "k", None, "n", datetime.date(2025, 1, 2)),) and book.notes[0][2] == datetime.date(2025, 1, 3)
    assert settings.load_ledger(tmp_path / "none.yaml") == settings.Ledger()
    for bad in ("issues:\n  - {problem: p, key: k, note: n}\n", "issues:\n  - {problem: p, key: k, note: '', added: 2025-01-02}\n", good.replace("2025-01-02", "02.01.2025"), "other: 1\n", "issues:\n" + "  - {problem: p, key: k, note: n, added: 2025-01-02}\n" * 2, good.replace("note: n, added: 2025-01-02", "note: n, added: 2025-01-02, x: 1")):
        with pytest.raises(settings.SettingsError):
            settings.parse_ledger(bad)


def test_keys_of_the_contract_and_with_underscores(tmp_path):
    both = SETTINGS
    for name in ("contentRoot", "knownIssuesFile", "staleImageDays", "registryPrefixes", "allowedCourses", "ownedDomains", "staleImageRefs", "minWords", "shingleSize", "ignoreElements", "alsoInCode", "driftBudget", "privateImages", "primaryDomain"):
        under = "".join("_" + c.lower() if c.isupper() else c for c in name)
        assert under in both
        both = both.replace(under, name)
    assert settings.parse(both, tmp_path) == settings.parse(SETTINGS, tmp_path)


@pytest.mark.parametrize("since,good", [(2026, True), ("2026-03", True), ("2026-13", False), ("March", False)])
def test_since(since, good, tmp_path):
    document = changed(("terminology",), [{"from": "a", "to": "b", "since": since}])
    if good:
        assert settings.parse(document, tmp_path).terms[0].since == str(since)
    else:
        with pytest.raises(settings.SettingsError, match="since"):
            settings.parse(document, tmp_path)
