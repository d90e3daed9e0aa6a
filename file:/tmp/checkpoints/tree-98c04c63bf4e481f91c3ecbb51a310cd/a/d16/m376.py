x376