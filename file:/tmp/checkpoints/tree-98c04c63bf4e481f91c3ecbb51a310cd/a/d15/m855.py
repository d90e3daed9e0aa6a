x855