from tests.conftest import sf, spark  # noqa: F401
