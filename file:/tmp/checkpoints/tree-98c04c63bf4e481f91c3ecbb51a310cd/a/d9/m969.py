x969