import random

import pytest

from millrace.llm import mojibake as M

rng = random.Random(6)
PARTS = {
    "fr": ["La tâche différée", "a échoué deux fois", "à l’étape deux", "n’a pas démarré", "dès la première erreur", "où prévu", "côté régie", "la clé vérifiée", "après la clôture"],
    "de": ["Die geprüfte Änderung", "läuft erneut", "wurde übersprungen", "außerhalb der Schicht", "für die größere Zählung", "muss gelöscht werden", "während der Übergabe"],
    "es": ["¿Por qué la versión", "se canceló por tamaño", "quedó sin dueño", "después del cierre", "llegó más tarde", "la última región"], "pl": ["Każda część", "zniknęła z węzła", "źródłowość", "wśród zgłoszeń", "księżyc łąka", "będzie później"],
    "ru": ["Проверьте, почему", "повторная запись", "была отменена", "после сбоя", "на втором узле", "ждёт проверки"], "ja": ["夜間の取込処理は", "停止しました。", "未確認の照合表を", "見てください。", "二度届きました、", "台帳も"],
    "en": ["The café rota — kept by", "isn’t “remote” and", "costs rose from £3 to €8 –", "the ½-hour window", "41 °C, so", "naïve résumé"],
}


def line(lang):
    return " ".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(2, 6)))


CLEAN = [line(k) for k in PARTS for _ in range(150)] + ["├── jobs", "│   └── x ✓", "PAS DÉMARRÉ À L’ÉTAPE", "SÃO e AÇÃO iguais"] * 20
MODEL = M.train(CLEAN)


def test_held_out_lines_are_found_and_restored():
    good = bad = 0
    for lang, chain in (("fr", (("utf-8", "cp1252"),)), ("de", (("utf-8", "cp1252"),) * 2), ("es", (("utf-8", "mac_roman"),)), ("pl", (("utf-8", "cp1252"),)), ("pl", (("cp1250", "cp1252"),)), ("ru", (("utf-8", "cp1251"),)),
                        ("ru", (("cp1251", "cp1252"),)), ("ru", (("koi8-r", "cp1251"),)), ("ja", (("euc_jp", "cp1252"),)), ("ja", (("utf-8", "cp1252"),)), ("en", (("utf-8", "cp437"),)), ("en", (("utf-8", "cp850"),))):
        for _ in range(20):
            s = line(lang)
            g = M.garble(s, chain)
            if g is None or g == s:
                continue
            k, back = MODEL.line(g)
            good, bad = good + (k > 0 and back == s), bad + (k == 0 or back != s)
    assert good > 200 and bad / (good + bad) < .03


def test_clean_lines_stay():
    assert sum(MODEL.line(line(k))[0] > 0 for k in PARTS for _ in range(60)) <= 2
    for s in ("Watch for `Ã¼` in headers.", "The dump printed “â€™” instead of it.", "├── jobs", "SÃO e AÇÃO iguais", "plain ascii", ""):
        assert MODEL.line(s) == (0, s)


def test_lost_bytes_and_part_of_a_text():
    g = M.garble("Die geprüfte Änderung läuft erneut", (("cp1252", "lossy"),))
    assert MODEL.line(g)[0] == M.LOSSY and MODEL.line(g)[1] == g
    clean, bad = line("fr"), M.garble(line("fr"), (("utf-8", "cp1252"),))
    ks, back = MODEL.text(f"{clean}\nascii\n{bad}")
    assert ks and back.split("\n")[:2] == [clean, "ascii"] and M.garble(back.split("\n")[2], (("utf-8", "cp1252"),)) == bad


@pytest.mark.parametrize("chain", M.CHAINS[1:])
def test_inverse_is_exact(chain):
    for s in CLEAN[::97]:
        g = M.garble(s, chain)
        if g is None or g == s:
            continue
        back = M.invert(g, chain)
        assert back is None or M.garble(back, chain) == g


def test_table(spark):
    bad = M.garble(line("fr"), (("utf-8", "cp1252"),))
    df = spark.createDataFrame([(1, bad, "x"), (2, None, "y"), (3, "", "z"), (1, bad, "x"), (4, line("de"), ""), (5, "ascii " * 9, "")], "doc_id long, text string, chains string")
    out = M.restore(df, model=MODEL).collect()
    assert [r.doc_id for r in out] == [1, 1] and out[0].recovered and M.garble(out[0].text, (("utf-8", "cp1252"),)) == bad
    assert M.restore(df.limit(0)).count() == 0


def test_fit_on_tables(spark):
    """Fitting by the executors equals fitting here; tables without anything to learn from give no rows."""
    bad = M.garble(line("de"), (("utf-8", "cp1252"),))
    rows = [(i, s, i) for i, s in enumerate(CLEAN[::4])] + [(9001, bad, 0), (9002, None, 0), (9003, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(3)
    assert 9001 in {r.doc_id for r in M.restore(df).collect()} and M.fit(df).w.any()
    for none in (df.limit(0), df.where("doc_id > 9001")):
        assert not M.fit(none).w.any() and M.restore(none).count() == 0
