x838