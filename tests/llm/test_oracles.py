import os

import pytest

from txscore.llm.oracles import ORACLES

from ..test_oracles import SF, same


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    same(spark, name)
