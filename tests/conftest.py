import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402

DATA = Path(os.environ.get("WEFTLINE_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    d = DATA / "sf0.001"
    if not d.exists():
        pytest.skip("no test tables here")
    return str(d)


#: Names that operators use for columns of their own.
CLASHES = ["n", "value", "field", "k", "state", "form", "h", "copies", "canon", "look", "chars", "weight", "norm", "vertex", "component", "a", "b", "v", "parent", "spans", "tag", "kind", "path", "key_value", "filled", "source_tag", "__v", "__src", "c", "p", "q"]


def _variant(folder, out, change):
    import pyarrow.parquet as pq

    out.mkdir(parents=True, exist_ok=True)
    for f in Path(folder).glob("*.parquet"):
        pq.write_table(change(f.stem, pq.read_table(f)), out / f.name)
    return str(out)


@pytest.fixture(scope="session")
def empty_dir(sf, tmp_path_factory):
    return _variant(sf, tmp_path_factory.mktemp("empty"), lambda name, t: t.slice(0, 0))


@pytest.fixture(scope="session")
def null_dir(sf, tmp_path_factory):
    """Twenty rows per table with every column null."""
    import pyarrow as pa

    def nulls(name, t):
        return pa.table({f.name: pa.nulls(20, f.type) for f in t.schema}, schema=t.schema)

    return _variant(sf, tmp_path_factory.mktemp("nulls"), nulls)


@pytest.fixture(scope="session")
def clash_dir(sf, tmp_path_factory):
    """The tables with extra columns whose names operators use themselves."""
    import pyarrow as pa

    def extra(name, t):
        have = {c.lower() for c in t.column_names}
        for c in CLASHES:
            if c.lower() not in have:
                t = t.append_column(c, pa.array(["x"] * t.num_rows))
        return t

    return _variant(sf, tmp_path_factory.mktemp("clash"), extra)


@pytest.fixture(scope="session")
def doubled_dir(sf, tmp_path_factory):
    """Every row of every table twice."""
    import pyarrow as pa

    return _variant(sf, tmp_path_factory.mktemp("doubled"), lambda name, t: pa.concat_tables([t, t]))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
