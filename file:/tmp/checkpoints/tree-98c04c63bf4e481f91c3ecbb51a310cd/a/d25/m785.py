x785