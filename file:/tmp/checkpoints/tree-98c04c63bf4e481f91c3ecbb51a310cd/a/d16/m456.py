x456