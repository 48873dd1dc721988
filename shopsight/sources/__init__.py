from shopsight.sources.files import read_table, read_retail_files, TRANSACTIONS_SCHEMA, CUSTOMERS_SCHEMA, PRODUCTS_SCHEMA
from shopsight.sources.standin import standin_tables, load_tables
from shopsight.sources.joined import join_facts

__all__ = [
    "read_table", "read_retail_files", "standin_tables", "load_tables", "join_facts",
    "TRANSACTIONS_SCHEMA", "CUSTOMERS_SCHEMA", "PRODUCTS_SCHEMA",
]
