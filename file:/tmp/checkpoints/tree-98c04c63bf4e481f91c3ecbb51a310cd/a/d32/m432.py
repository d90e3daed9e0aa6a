x432