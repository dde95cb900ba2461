import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from sparkdq.session import get_session

    s = get_session("local[4]", shuffle_partitions=8, app_name="sparkdq-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def dq_sample(spark):
    """11 invented rows with the DQ sample's defect pattern."""
    rows = [
        (1, "Alice", "alice@example.com", "555-0101", "2023-01-05", 10.5),
        (2, "Bob", "bob@example.com", "555-0102", "2023-02-11", 20.0),
        (3, "Cara", None, "555-0103", "2023-03-15", 15.0),
        (4, "Dan", "dan@example", "555-0104", "2023-04-20", -5.0),
        (5, "Eve", "eve@example.com", None, "2023-05-01", 30.0),
        (6, "Finn", "finn@example.com", "555-0106", "2023-06-12", None),
        (7, "Gia", None, "555-0107", "2023-07-07", 12.0),
        (8, "Hal", "hal@example.com", None, "2023-08-08", 18.0),
        (9, "Ivy", "ivy@example.com", "555-0109", "2023-09-09", 22.0),
        (10, "Jon", "jon@example.com", "555-0110", "2023-10-10", 25.0),
        (10, "Jon", "jon@example.com", "555-0110", "2023-10-10", 25.0),
    ]
    return spark.createDataFrame(
        rows, "id bigint, name string, email string, phone string, signup_date string, price double")


@pytest.fixture(scope="session")
def pii_sample(spark):
    """One fixed row that the masking golden needs, and five invented ones with two bad e-mails and odd phones."""
    rows = [
        (1, "John Doe", "john.doe@example.com", "+1-123-456-7890", "1990-01-01", "12 Main St, Springfield", "vip"),  # fixed
        (2, "Maria Stone", "jolenmarsh@example", "9998887777", "1985-02-02", "7 Quay, Paris", None),
        (3, "Ole Vik", None, "701-222-3344", "1979-03-03", "5 Dock Rd, Berlin", "call later"),
        (4, "Amber Rhodes", "amberlynnrhodes@example.com", "702-333-4455", "2000-04-04", "8 Fen Ln, Madrid", None),
        (5, "Bo Chan", "bo@example.com", "703-444-5566", "1995-05-05", "90 Ash Ln, Rome", "n"),
        (6, "Cy Diaz", "cy@example.com", None, "1988-06-06", "11 Birch Ct, Lyon", None),
    ]
    return spark.createDataFrame(
        rows, "id bigint, name string, email string, phone string, signup_date string, address string, notes string")
