x501