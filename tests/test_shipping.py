"""Functions for Python workers must load where this repository is not installed."""

import base64
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from framekiln.functions import images
from framekiln.operators import features, lockstep
from framekiln.sources import tar
from workload import media, texts

SHIPPED = {
    "decoder": images.default_decoder,
    "model": features.image_model(media.toy_image_model),
    "vision": media.grid_tokens,
    "tagger": texts.nameless_tagger,
    "reader": tar.TarReader({"path": ""}),
    "source": tar.TarShards,
    "exits": lockstep._exits,
}


@pytest.mark.parametrize("name", list(SHIPPED))
def test_loads_elsewhere(name):
    data = base64.b64encode(cloudpickle.dumps(SHIPPED[name])).decode()
    code = (
        "import base64, sys; from pyspark import cloudpickle; sys.path = [p for p in sys.path if 'repo' not in p]; "
        f"x = cloudpickle.loads(base64.b64decode('{data}')); "
        + ("x()" if name in ("decoder", "model", "vision", "tagger") else "pass")
    )
    subprocess.run([sys.executable, "-c", code], cwd="/", check=True, timeout=120)
