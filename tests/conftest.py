import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]

from food_rows import AMINO, FATTY, FOODS

from larder.plans import food
from larder.session import local_session
from larder.sources.grid import read_grid


@pytest.fixture(scope="session")
def spark():
    session = local_session("larder-tests", cores="4", memory="4g")
    yield session
    session.stop()


def _csv_cell(text):
    return "" if text is None else '"' + text + '"'


def _sheet_rows(sheet, foods):
    """Header, group separators, header repeats and data rows as they stand in a sheet."""
    columns = food.SHEETS[sheet]
    rows = [["Número do", "Descrição dos alimentos"], ["Alimento", None]]
    group = None
    for key, name, its_group, cells in foods:
        if its_group != group:
            rows.append([its_group, None])
            group = its_group
            rows.append([None, "per 100 g"])
        values = ["again" if c is None else cells.get(c, "1") for c in columns[2:]]
        rows.append([str(key), name, *values])
    return [row + [None] * (len(columns) - len(row)) for row in rows]


@pytest.fixture(scope="session")
def sheets(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sheets")
    by_id = {f[0]: f for f in FOODS}
    fatty = [(k, by_id[k][1] if k in by_id else "Only here", by_id[k][2] if k in by_id else "Outros", c) for k, c in FATTY.items()]
    amino = [(k, by_id[k][1], by_id[k][2], c) for k, c in AMINO.items()]
    paths = {}
    for sheet, foods in (("main", FOODS), ("fatty_acids", fatty), ("amino_acids", amino)):
        path = folder / f"{sheet}.csv"
        lines = [",".join(_csv_cell(c) for c in row) for row in _sheet_rows(sheet, foods)]
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
        paths[sheet] = str(path)
    return paths


@pytest.fixture(scope="session")
def bronze(spark, sheets):
    return food.bronze({s: read_grid(spark, p, len(food.SHEETS[s])) for s, p in sheets.items()})


@pytest.fixture(scope="session")
def star(spark, bronze, tmp_path_factory):
    built = food.gold(spark, food.silver(bronze), "table")
    return food.write_gold(built, str(tmp_path_factory.mktemp("gold")))
