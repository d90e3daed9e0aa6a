x491