x934