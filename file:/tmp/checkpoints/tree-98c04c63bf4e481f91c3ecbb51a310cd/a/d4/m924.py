x924