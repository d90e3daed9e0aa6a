x340