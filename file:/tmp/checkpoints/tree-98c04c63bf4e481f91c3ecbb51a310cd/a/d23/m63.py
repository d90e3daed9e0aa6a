x63