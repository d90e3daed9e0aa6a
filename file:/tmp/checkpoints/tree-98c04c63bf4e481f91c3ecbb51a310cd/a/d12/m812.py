x812