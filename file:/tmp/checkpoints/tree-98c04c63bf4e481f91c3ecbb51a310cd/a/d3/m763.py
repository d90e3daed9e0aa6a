x763