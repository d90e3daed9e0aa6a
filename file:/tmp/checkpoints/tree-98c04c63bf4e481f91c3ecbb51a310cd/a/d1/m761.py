x761