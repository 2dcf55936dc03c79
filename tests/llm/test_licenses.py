import hashlib

from maskwright.llm import licenses
from maskwright.llm.license_texts import KNOWN


def test_whole_texts(spark, hard, hard_rows, empty):
    known = licenses.known_licenses(spark)
    mit = KNOWN["MIT"]
    rows = [
        (1, mit), (2, mit.upper().replace(",", " ;")), (3, "MIT License\n\nCopyright (c) 2020 Jane Doe\n" + mit.removeprefix("MIT License\n\n")), (4, mit + " More."), (5, mit[:-20]),
        (6, KNOWN["BSD-3-Clause"].replace("copyright holder", "Copyright  Owner")), (7, "© 2019 X\nAll rights reserved.\n" + KNOWN["ISC"]), (8, KNOWN["Zlib"].replace("acknowledgment", "acknowledgement")), (9, "released under the mit licence"), (10, None), (11, "..."),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert {i: r.license_id for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: "BSD-3-Clause", 7: "ISC", 8: "Zlib", 9: "MIT (notice)", 10: None, 11: None}
    assert got[10].digest == got[11].digest == hashlib.sha256(b"").hexdigest()
    assert licenses.scan_licenses(hard, known).count() == len(hard_rows)
    assert licenses.scan_licenses(empty, known).count() == 0 and licenses.scan_licenses(hard, known.limit(0)).where("license_id is not null").count() == 0


def test_no_known_text_shares_a_digest(spark):
    known = licenses.known_licenses(spark)
    assert known.select(licenses.digest(known.text)).distinct().count() == len(KNOWN)
