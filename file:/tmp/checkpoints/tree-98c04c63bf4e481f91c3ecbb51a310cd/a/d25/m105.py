x105