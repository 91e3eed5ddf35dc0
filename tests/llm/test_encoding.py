from __future__ import annotations

import math
from collections import Counter

from mnemospark.llm import encoding as E

GOOD = ["Die Prüfung der Gespräche: größtenteils überflüssig für später.", "Le résumé précédent a été écrasé ; l’été, la forêt — et le café.", "Część notatek wciąż nie ma oceny, więc próg został obniżony."]


def bad(text: str) -> str:
    return text.encode().decode("cp1252", errors="replace").replace("�", "")


def test_one_damaged_text_as_a_third_of_all_rows(spark):
    damaged = GOOD[0].encode().decode("cp1252")
    rows = [(i, f"{i} {GOOD[i % 3]}") for i in range(60)] + [(1000 + i, damaged) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = {r.id: r.restored for r in E.repair_encoding(df).collect()}
    assert found == {1000 + i: GOOD[0] for i in range(300)}


def test_joined_words_give_the_same_result(spark):
    damaged = GOOD[0].encode().decode("cp1252")
    rows = [(i, f"{i} {GOOD[i % 3]}") for i in range(60)] + [(100 + i, f"{damaged} {i}") for i in range(5)] + [(200, "Lost caf� here."), (201, None), (202, ""), (203, "plain")]
    df = spark.createDataFrame(rows, "id long, text string")
    shared, joined = ({(r.id, r.restored) for r in E.repair_encoding(df, E.RepairParams(shared_words=n)).collect()} for n in (1000, 0))
    assert shared == joined and len(shared) == 6 and (200, "") in shared


def test_search_has_no_cap():
    counts = Counter()
    for t in GOOD * 40:
        for w in E.odd_words(t):
            counts.update(E.pairs_of(w))
    text = GOOD[0]
    for _ in range(5):  # deeper than any fixed depth
        text = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in text.encode())
    assert E.Repairer(E.Plausibility(counts), E.RepairParams()).repair(text) == GOOD[0]
    narrow = E.Repairer(E.Plausibility(counts), E.RepairParams(worst_step=math.inf, step_cost=6.0))
    assert narrow.repair("PrÃ¼fung") == "Prüfung"


def test_longer_examples_by_parameter():
    counts = Counter()
    for t in GOOD * 40:
        for w in E.odd_words(t):
            counts.update(E.pairs_of(w))
    text = "The log showed `Ã©Ã¼Ã¶Ã¤Ã³Ã±` once."
    assert E.Repairer(E.Plausibility(counts), E.RepairParams(example=40)).repair(text) is None
