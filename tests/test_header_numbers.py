from proofmill.operators import sections as S


def test_header_numbers_beyond_an_int(spark):
    lines = [(1, 0, "Normal", "4703443633947811 Achverber auf"), (1, 1, "Normal", "text"), (1, 2, "Normal", "12. NEWS"), (1, 3, "Normal", "more"), (2, 0, "Normal", "2147483648 X"), (2, 1, "Normal", "2147483647 Y")]
    out = S.segment_paragraphs(spark.createDataFrame(lines, "pack_id long, ord long, style string, text string"))
    rows = sorted((r.pack_id, r.ord, r.section_no, r.name, r.content) for r in out.collect())
    assert rows == [(1, 1, None, "Achverber auf", "text"), (1, 2, 12, "NEWS", "more"), (2, 1, None, "X", ""), (2, 2, 2147483647, "Y", "")]
    cells = S.segment_cells(spark.createDataFrame([(1, "99999999999 CARD\nbody")], "cell_id long, text string"))
    assert [tuple(r) for r in cells.collect()] == [(1, None, "CARD", "body", "99999999999 CARD")]
