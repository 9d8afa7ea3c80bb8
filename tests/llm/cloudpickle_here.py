"""Sends a module to the workers as it is in this process, with the constants a test has changed."""

import contextlib

from pyspark import cloudpickle


@contextlib.contextmanager
def by_value(module):
    cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(module)
