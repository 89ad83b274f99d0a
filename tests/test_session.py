import os
import subprocess
import sys
import zipfile
from pathlib import Path

from tidemark import session

ROOT = Path(__file__).resolve().parents[1]


def test_an_area_leaves_no_folder_behind(spark):
    before = session.scratch_folder(spark)
    with session.scratch_area(spark) as area:
        table = session.checkpoint(spark.range(10))
        assert table.count() == 10 and area in table.inputFiles()[0]
        with session.scratch_area(spark) as inner:
            assert session.scratch_path(spark, "x").startswith(inner)
    assert session.scratch_folder(spark) == before
    assert not Path(area.removeprefix("file:")).exists()


def test_shipped_from_another_folder(tmp_path):
    """A zip given as a Python file reaches the workers of a job started elsewhere."""
    with zipfile.ZipFile(tmp_path / "tidemark.zip", "w") as z:
        for path in sorted((ROOT / "tidemark").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    job = tmp_path / "job.py"
    job.write_text(
        "import sys; sys.path.insert(0, 'tidemark.zip')\n"
        "from tidemark.session import get_session\n"
        "from tidemark.operators.hierarchy import cut, linkage\n"
        "spark = get_session(**{'spark.master': 'local[2]', 'spark.ui.enabled': 'false', 'spark.submit.pyFiles': 'tidemark.zip', 'spark.sql.shuffle.partitions': '2'})\n"
        "rows = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 9.0)], 'id long, x double')\n"
        "print(sorted(map(tuple, cut(linkage(rows, ['x'], 'id'), [2]).collect())))\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "[(0, 2, 0), (1, 2, 0), (2, 2, 1)]" in done.stdout, done.stderr[-2000:]
