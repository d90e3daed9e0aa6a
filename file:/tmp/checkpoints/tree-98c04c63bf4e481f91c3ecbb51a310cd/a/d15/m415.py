x415