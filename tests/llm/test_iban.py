"""Account numbers with upper-case words behind them."""
from assaykit.llm import pii


def test_words_behind_an_iban(spark):
    es, at, gb = "ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32"
    texts = [f"{es} EUR", f"pay {at} BIC ABCD", f"{gb} EUR", es, f"{at.replace(' ', '')} USD", "ES91 2100 0418 4502 0005 1333 EUR"]
    rows = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [(s.start, s.end, s.value) for s in r.spans if s.kind == "iban"] for r in rows}
    assert got == {0: [(0, 29, es)], 1: [(4, 28, at)], 2: [(0, 27, gb)], 3: [(0, 29, es)], 4: [(0, 20, at.replace(" ", ""))], 5: []}
