x985