"""Plans that compose operators: parsing of documents, rendering of test documents."""
