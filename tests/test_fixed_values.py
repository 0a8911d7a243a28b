"""Values that results depend on and that the queries' oracles take from the operators: said here once more, on their own."""

from tidewrack.functions import columns as C
from tidewrack.operators import findings, heuristics, score


def words(text):
    return tuple(text.split())


def test_paths():
    assert sorted(C.IGNORED_DIRS) == sorted(words(".git .hg .svn .venv venv node_modules dist build __pycache__ .pytest_cache .mypy_cache .ruff_cache .reviews reports .tox coverage .idea .vscode .superpowers"))
    assert sorted(C.IGNORED_SUFFIXES) == sorted(words(".png .jpg .jpeg .gif .webp .ico .pdf .zip .gz .tar .woff .woff2 .ttf .eot .mp3 .mp4 .wasm .lock"))
    assert sorted(C.BAND1_HINTS) == sorted(words(".env secret password credential auth jwt oauth session security crypto tls ssl firewall permission rbac"))
    assert sorted(C.BAND2_HINTS) == sorted(words("controller service model route api/ handlers"))


def test_findings():
    assert C.SCANNERS == words("gitleaks semgrep osv trivy checkov")
    assert heuristics.PREFIX_PAIRS == tuple(tuple(p.split("/")) for p in words("Extract/Replace Create/Delete Add/Remove Insert/Delete Open/Close Start/Stop Begin/End Get/Set Show/Hide Enable/Disable"))
    assert C.ALWAYS_LAZY == ("not reviewed", "not explicitly reviewed", "not addressed in this document") and C.SOFT_LAZY == ("could be improved", "partially addressed")
    assert C.CONCRETE == ("no http", "no html", "no sql", "no orm", "no network", "not present", "out of scope", "n/a for", "in pack", "in provided", "in reviewed", "desktop app")
    assert findings.INJECTION == r"(?i)sec\.injection|command\s+injection|subprocess"


def test_checklist():
    ids = {band: [i for b, i, full, _ in score.MATRIX if b == band and not full] for band in ("p1", "p2", "p3")}
    assert ids["p1"] == ["sec." + x for x in words("injection xss_csrf authn_authz repo_hygiene_secrets data_exposure deps_supply_chain transport_tls crypto_deser input_validation")]
    assert ids["p2"] == ["rel." + x for x in words("edge_cases concurrency error_recovery performance")]
    assert ids["p3"] == ["arch." + x for x in words("structure_size readability_complexity duplication dead_code consistency_style api testing ci_durability blast_radius")]
    assert len(score.MATRIX) == 45 and sum(full for _, _, full, _ in score.MATRIX) == 23
