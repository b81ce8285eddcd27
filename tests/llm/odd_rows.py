"""Rows that every operator has to handle."""

LONG = "word another third " * 4000 + "\n" + "x" * 9000

#: doc_id, text: nulls, empty and blank texts, ties, repeated rows, a long text, odd white space.
ODD = [
    (7, "One line of some words that is long enough to count here.\n\nSecond line, with more words in it than ten of them are."),
    (3, "One line of some words that is long enough to count here.\n\nSecond line, with more words in it than ten of them are."),
    (3, "One line of some words that is long enough to count here.\n\nSecond line, with more words in it than ten of them are."),
    (3, "Another text under the same id; token = \"0123456789abcdef0123456789abcdef\" ends it."),
    (5, None),
    (6, ""),
    (8, " \n\t\n  "),
    (9, LONG),
    (10, "ÀÉÎ ñandú ß 日本語   em\x0bvertical\x1cfile\x00nul"),
    (11, "12345 67890 !!!"),
    (12, "A b\r\nA b\r\nA b\r\nC"),
    (None, "No id but a text that has a few words, enough of them for a run."),
    (None, "One line of some words that is long enough to count here.\nAnd then something else."),
    (-4, "negative id with words"),
    (1 << 40, "far id with words"),
]
