x856