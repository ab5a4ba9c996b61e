import pytest


@pytest.fixture
def by_value():
    """Sends modules to the workers as they are here, so that what a test patches holds there too."""
    from pyspark import cloudpickle

    sent = []

    def send(module):
        cloudpickle.register_pickle_by_value(module)
        sent.append(module)

    yield send
    for module in sent:
        cloudpickle.unregister_pickle_by_value(module)
